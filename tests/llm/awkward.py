"""Rows that every operator must take."""

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows that are awkward: nulls in every column, empty, blank and very long texts, repeats and ties."""
    long_text = " ".join(f"w{k * k % 977}" for k in range(30_000))
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree at night"
    near = base.replace("night", "noon")
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (3, near, "en", None, 1), (4, None, "fr", "a", None), (5, "", None, "b", 0),
        (6, " \n\t ", "de", "c", 3), (7, long_text, "en", "c", 9), (8, "two words", "es", "a", 9), (8, "two words", "es", "a", 9), (None, base, None, None, None),
        (None, "nobody owns this little text at all", "en", "d", 5), (9, "Two WORDS", "es", "d", 9), (10, "été – naïve café 世界", "fr", "a", 20),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def clashing(docs):
    """The same with further columns, named like those that the operators use inside."""
    for name in ("token", "node", "n", "label", "score", "size", "draw", "_times", "_cut", "_toxicity", "_row_key", "place", "_at", "component_id", "item_id", "shard"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
