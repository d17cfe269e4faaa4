import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Nulls, empty and blank texts, ties, repeated rows, one long text.
ODD = [
    (1, "a b c", "en", "s1", 5),
    (2, "a  b\tc", "en", "s1", 6),
    (3, None, "en", None, None),
    (4, "", None, "s2", 0),
    (5, " \n\t", "en", "s2", 3),
    (6, "é ü \U0001f600 ñ", "xx", "s1", 7),
    (6, "é ü \U0001f600 ñ", "xx", "s1", 7),
    (None, "no id", "en", "s3", 5),
    (7, "x" * 9000 + " y" * 4000, "en", "s3", 17000),
    (8, "abc", "en", "s1", 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
