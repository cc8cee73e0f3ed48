import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # names that operators use themselves
        *[T.StructField(n, T.StringType()) for n in ("row", "fp", "hit", "items", "n", "part", "score", "number", "word")],
    ]
)
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards pack a dozen boxes "


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, language), with columns of clashing names."""

    def make(*rows):
        return spark.createDataFrame([(*r, None)[:3] + ("x",) * 9 for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeated rows and a very long text."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (None, PROSE), (None, None),
        (5, PROSE * 1500), (6, "!"), (7, "日本語テキスト"), (8, "x" * 3000),
    ]
