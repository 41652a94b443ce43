import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    """Builds small documents tables: rows of (doc_id, text), or with source and further columns whose names clash with added ones."""

    def make(rows, *more):
        fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in more)]
        return spark.createDataFrame(rows, T.StructType(fields))

    return make
