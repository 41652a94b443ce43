"""Catalog queries over the dataset, model and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions.columns import col

DATASETS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("filename", T.StringType()),
    T.StructField("original_filename", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("cleaned_path", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("upload_time", T.TimestampType()), T.StructField("file_size", T.StringType()),
    T.StructField("row_count", T.IntegerType()), T.StructField("column_count", T.IntegerType()),
])
MODELS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("dataset_id", T.StringType()),
    T.StructField("dataset_filename", T.StringType()), T.StructField("target_column", T.StringType()),
    T.StructField("model_name", T.StringType()), T.StructField("problem_type", T.StringType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("model_path", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
])
REPORTS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("dataset_id", T.StringType()),
    T.StructField("dataset_filename", T.StringType()), T.StructField("report_filename", T.StringType()),
    T.StructField("report_path", T.StringType()), T.StructField("created_at", T.TimestampType()),
])


def list_newest_first(df: DataFrame, time: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.asc(tie))


def find(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the condition reaches the scan."""
    return df.filter(col(key) == F.lit(value))


def link_dataset(records: DataFrame, datasets: DataFrame, filename: str = "dataset_filename") -> DataFrame:
    """Attach the id of the dataset with the same file name (the smallest, if several have it), empty text where there is none."""
    ids = datasets.groupBy(col("filename").alias("_file")).agg(F.min(col("id")).alias("_id"))
    joined = records.join(ids, col(filename) == F.col("_file"), "left")
    return joined.withColumn("dataset_id", F.coalesce("_id", F.lit(""))).drop("_file", "_id")


def delete(df: DataFrame, key: str, value) -> tuple[DataFrame, bool]:
    """The table without the record, and whether the record existed."""
    existed = not find(df, key, value).isEmpty()
    return df.filter(~col(key).eqNullSafe(F.lit(value))), existed


def counts(**tables: DataFrame) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def best_accuracy(models: DataFrame, accuracy: str = "accuracy") -> DataFrame:
    """Best accuracy in percent, 0 without any."""
    return models.agg(F.coalesce(F.round(F.max(col(accuracy)) * 100, 2), F.lit(0.0)).alias("best_accuracy"))


def recent(models: DataFrame, time: str, tie: str, n: int = 5, columns: list[str] | None = None) -> DataFrame:
    top = models.orderBy(F.desc(time), F.asc(tie)).limit(n)
    return top.select(*columns) if columns else top
