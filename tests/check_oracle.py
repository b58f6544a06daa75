"""Compare queries with their oracle SQL: python tests/check_oracle.py [sf] [key-prefix ...]"""

import datetime
import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import duckdb

import __spark_entry__ as entry_module
from reelmetrics.plans.bindings import TABLES
from reelmetrics.session import build_session


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(con, df, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(got)
    decimals = [n for n, t in zip(names, rel.types) if "DECIMAL" in str(t)]
    idx = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    if decimals:
        return f"decimal columns {decimals}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; {[g for g in got if g not in set(want)][:2]} {[w for w in want if w not in set(got)][:2]}", len(got)
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} differ, cols {cols}: {bad[:2]}", len(got)
    for n, t in zip(names, rel.types):
        s = df.schema[n].dataType.simpleString()
        floats, d = s in ("double", "float"), str(t) in ("DOUBLE", "FLOAT")
        if floats != d:
            return f"type {n}: {s} vs {t}", len(got)
    return None, len(got)


def main(argv):
    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    keys = [k for k in queries if len(argv) < 2 or any(k.startswith(p + "_" if p[-1].isdigit() else p) for p in argv[1:])]
    bad = 0
    for key in keys:
        t0 = time.time()
        try:
            if key in oracles:
                problem, n = compare(con, queries[key](spark, folder), oracles[key])
            else:
                problem, n = None, len(queries[key](spark, folder).collect())
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:600]}", -1
        bad += problem is not None
        flag = "BAD" if problem else "ok" if key in oracles else "rows"
        print(f"{flag:4} {key} n={n} {time.time() - t0:.1f}s {problem or ''}"[:1500], flush=True)
    print(f"{len(keys)} run, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
