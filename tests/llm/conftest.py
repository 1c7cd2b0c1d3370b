import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, pos int, id string"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents (with extra columns whose names the operators use inside) from (doc_id, text) rows."""

    def make(rows, **more):
        full = [(i, t, more.get("lang", {}).get(i), "s", None, "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "the MIT License, MIT License"), (4, "the MIT License, MIT License"), (5, "a b c d e " * 30_000), (None, "null id"), (7, "É" * 300), (8, "x"), (9_007_199_254_740_993, "a large id")]
