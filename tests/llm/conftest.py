import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return FOLDER


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text, lang, source) rows with columns whose names the operators use themselves."""

    def make(rows):
        filled = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame(filled, "doc_id long, text string, lang string, source string")
        extra = ("fp", "bucket", "digest", "size", "key", "count", "host", "_id", "_doc", "_row", "_all", "runs", "doc", "row", "taken", "score", "_counts")
        for name in extra:
            df = df.selectExpr("*", f"'x' as {name}")
        return df.selectExpr("*", "cast(length(text) as bigint) as n_chars")

    return make
