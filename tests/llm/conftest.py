import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

LONG = "lorem ipsum dolor sit amet " * 20_000

#: Columns that no operator may trip over.
SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()), StructField("kept", StringType()),
    StructField("hash", StringType()), StructField("row", StringType()), StructField("id", DoubleType()),
    StructField("start", StringType()), StructField("component", StringType()), StructField("_part", StringType()),
])


def make_docs(spark, rows, lang="en", source="a"):
    """(doc_id, text) pairs, or longer tuples that go on with lang and source, under all columns."""
    full = []
    for r in rows:
        r = list(r) + [lang, source][len(r) - 2:] if len(r) < 4 else list(r)
        full.append((r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), "k", "h", None, 1.5, "s", "c", "p"))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, copies, ties and repeated rows."""
    return make_docs(spark, [
        (1, "the same text of some words here", "en", "a"), (5, "the same text of some words here", "de", "b"),
        (3, "the same text of some words here", None, None), (7, None), (8, ""), (9, " \n\t "), (10, LONG), (11, LONG),
        (12, "one row twice and then some more words"), (12, "one row twice and then some more words"),
        (13, "Ünïcödé … 文字 \U0001f600 end"), (None, "no id at all but a text of words"), (14, None, None, None),
    ])


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def sf01():
    return "/root/testdata/sf0.01"
