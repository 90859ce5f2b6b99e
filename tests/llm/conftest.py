import random

import pytest
from pyspark.sql import types as T

from tests.conftest import SF

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("n", T.StringType()), T.StructField("kept", T.StringType())])


def docs_frame(spark, rows):
    """Documents from (doc_id, text, lang, source) rows, with extra columns of clashing names."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "a", "b", "c", "d", "e") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    short = " ".join(words[:40])
    return [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, long, "de", "b"),
            (5, short, "en", "a"), (6, short, None, "b"), (7, short + " x", "en", "a"), (7, short + " x", "en", "a"),
            (8, "one two three", "en", None), (None, short, "en", "a"), (None, None, None, None),
            (9, "Été à la plage. ça va", "fr", "c"), (10, "?!... --", "en", "c"), (11, "12 34", "en", "c")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return docs_frame(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(SF["0.001"] + "/documents.parquet")
