"""Scene queries against their SQL where events lack a time, an id, a user, a value or a level."""

import datetime

import duckdb
import pytest
from check_oracle import compare

import __spark_entry__ as entry_module

DAY = datetime.datetime(2024, 1, 1)


def events():
    def row(user, i, value=10.0, k=0, kind="view", ts=True, eid=True):
        at = DAY + datetime.timedelta(minutes=i) if ts else None
        return (user * 1000 + i if eid else None, at, user, kind, value, "{}" if k is None else f'{{"k": {k}}}')

    out = []
    for user, missing in ((1, None), (2, 32), (3, 20), (4, 38)):  # a fade at frame 30, up to 9 frames from a missing level
        out += [row(user, i, 500.0 if i == 30 else 10.0, None if i == missing else i * (i + 59) // 2) for i in range(45)]
        out += [row(user + 4, 45 - i, 500.0 if i == 15 else 10.0, None if i == missing else i * (i + 59) // 2) for i in range(45)]
    for i in range(12):  # means of the values that are there decide the type
        out.append(row(9, i, None if i % 2 else 60.0, None if i % 3 else 20, "click"))
        out.append(row(10, i, None, None, "click"))
        out.append(row(11, i, 10.0 * i, i * 40, "click", ts=i % 4 > 0, eid=i % 5 > 0))
        out.append((20_000 + i, DAY, None, "view", 1.0, '{"k": 50}'))
    return out


@pytest.mark.parametrize("name", ["A17_scene_summary", "W4_segments", "W6_transition_types"])
def test_scene_queries_follow_their_sql_over_nulls(spark, tmp_path, name):
    ddl = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events(), ddl).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    sql = entry_module.oracle_sql()[name]
    assert compare(con, entry_module.queries()[name](spark, str(tmp_path)), sql)[0] is None
    if name == "W6_transition_types":
        assert ("fade",) in con.sql(f"SELECT DISTINCT transition FROM ({sql})").fetchall()
