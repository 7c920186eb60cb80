import pytest
from pyspark.sql import Row

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """All documents of the smallest tables, as Spark rows and as a plain list of (id, text)."""
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    return frame, [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


@pytest.fixture
def make(spark):
    """A documents table from texts (ids count up) or (id, text) pairs."""

    def build(items, extra=None):
        rows = [item if isinstance(item, tuple) else (k, item) for k, item in enumerate(items)]
        rows = [Row(doc_id=i, text=t, lang=None, source=None, n_chars=len(t or "")) for i, t in rows]
        frame = spark.createDataFrame(rows, DOCS)
        return frame.selectExpr("*", *extra) if extra else frame

    return build


AWKWARD = [None, "", "   \n\t ", "one", "one", "word " * 30_000, "a\x0bb\x0cc\rd", "ünï 😀  x", (None, "lost id"), (3, "one")]


@pytest.fixture
def awkward(make):
    """Nulls, empty and very long texts, ties, repeated rows, a null and a repeated id."""
    return make(AWKWARD)
