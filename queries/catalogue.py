"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import cleaning, features, models, monitoring, profiling, streams  # noqa: F401
from queries.base import QUERIES, SQL, Tables, rounded  # noqa: F401
from tablelab.operators.eda import numeric_summary
from tablelab.plans.basic_cleaning import BasicCleaning


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    customers = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    joined = t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
    plan = BasicCleaning.fit(joined)
    return rounded(numeric_summary(plan.transform(joined)))
