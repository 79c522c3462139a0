import pytest
from pyspark.sql import functions as F

#: Names that operators use inside; columns called so must not disturb them.
CLASHES = ["size", "taken", "key", "row", "rep", "kept", "spans", "did", "tag", "body", "host", "rule", "score", "ids", "start", "words", "digest", "first", "w", "h", "grp", "label2", "copy", "root"]


@pytest.fixture
def clash():
    """Adds columns whose names operators use inside."""
    return lambda df: df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})


@pytest.fixture
def documents(spark):
    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2 :])[:4] for r in rows]
        return spark.createDataFrame([(a, b, c, d, len(b) if b else 0) for a, b, c, d in full], "doc_id long, text string, lang string, source string, n_chars long")

    return make
