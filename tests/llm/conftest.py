import pytest

from graphloom.llm.common import prepared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Function from (doc_id, text[, source]) rows to a documents table with columns
    whose names clash with those that operators use inside."""
    prepared(spark)

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        return spark.createDataFrame(full, DOCS).selectExpr(
            "*", "1 AS n", "'x' AS key", "2 AS pos", "3 AS rank", "4 AS size", "true AS kept", "5 AS score", "6 AS row")

    return make


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
