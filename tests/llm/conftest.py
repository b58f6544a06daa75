import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use inside.
CLASHING = "id long, key string, n long, token long, component string, kept boolean, copies long, label int, score double, kept_id long, range int"


@pytest.fixture
def documents(spark):
    """A documents table from texts (ids from 0) or (id, text[, source]) rows; with ``clash`` it has
    further columns whose names operators use themselves."""

    def build(rows, clash=False):
        full = []
        for k, row in enumerate(rows):
            row = (k, row) if row is None or isinstance(row, str) else row
            full.append((row[0], row[1], "en", row[2] if len(row) > 2 else "s", None if row[1] is None else len(row[1])))
        if not clash:
            return spark.createDataFrame(full, SCHEMA).repartition(3)
        names = CLASHING.split(", ")
        return spark.createDataFrame([r + (None,) * len(names) for r in full], f"{SCHEMA}, {CLASHING}").repartition(3)

    return build


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"
