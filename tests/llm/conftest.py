import pytest
from pyspark.sql import functions as F

from shelfwise.llm.common import prepare

ODD_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, line int, dropped string, ids string, `range` int"


@pytest.fixture(autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and columns with the names that operators use themselves."""
    long = "\n".join(f"word{i} and more words in a very long text number {i * 7}" for i in range(20_000))
    rows = [
        (1, None, "en", "a", 5), (2, "", None, None, None), (3, " \n\t ", "en", "a", 3), (4, "hello", "de", "b", 5),
        (5, long, "en", "a", len(long)), (None, "no name but some words that stand in a text", "en", "c", 1),
        (6, "the same words stand in these two documents as they are copies", "en", "a", 9),
        (7, "the same words stand in these two documents as they are copies", "en", "a", 9),
        (7, "the same words stand in these two documents as they are copies", "en", "a", 9),
        (8, "€ ñ 漢字 \x1c control <|endoftext|> sign", "en", "a", 9),
    ]
    return spark.createDataFrame([(*r, 1.0, "x", 3, "y", "z", 1) for r in rows], ODD_SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit(0.5))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
