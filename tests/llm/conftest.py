import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names clash with those the operators make for themselves.
CLASHING = ("n", "fp", "u", "v", "root", "path", "part", "size", "shard", "first", "start", "words")


@pytest.fixture
def make_docs(spark):
    """Documents from texts, or (doc_id, text) pairs, with clashing extra columns."""
    def make(*texts, extra=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(i, t, "en", "src", len(t) if t else 0) for i, t in rows]
        docs = spark.createDataFrame(full, T._parse_datatype_string(DOCS))
        if extra:
            from pyspark.sql import functions as F
            docs = docs.select("*", *(F.lit(1).alias(c) for c in CLASHING))
        return docs
    return make
