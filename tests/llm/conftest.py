import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
#: Names that operators use inside.
CLASHING = ("n", "copy", "rate", "shard", "key", "component_id", "ids", "score", "parts", "sums", "rate_source", "lost_id", "lost_lines", "row", "table", "grp", "place", "digest", "found", "steps", "block",
            "node", "cluster", "component", "group", "unit", "chunk", "rank", "line", "d1", "d2", "first", "kept", "hashes", "pick", "tie", "up", "size")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, ties, repeats, a long text and clashing columns."""
    long = " ".join(f"w{i}" for i in range(20_000))
    return [None, "", "   \n\t ", "one", "one two", "One TWO", "a b c d e f g h", "a b c d e f g h", "é ü ñ", "123 456", "x" * 5000, long, long + " tail", "\n\n", "line\nline\nLine \nother"]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts):
    """doc_id, text and columns whose names clash with those that operators add."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                           *(T.StructField(c, T.StringType()) for c in CLASHING)])
    rows = [(i, t, None if i % 5 == 0 else ("en" if i % 2 else "fr"), None if i % 4 == 0 else "s", None, *["x"] * len(CLASHING)) for i, t in enumerate(odd_texts)]
    rows += [rows[6], (None, "a b c d e f g h", "en", "s", 1, *["x"] * len(CLASHING))]
    return spark.createDataFrame(rows, schema)
