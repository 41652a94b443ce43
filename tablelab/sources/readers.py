"""Readers by file type, with delimiter detection for text tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions.columns import col, string_columns

DELIMITERS = (",", ";", "\t", "|")
SAMPLE_LINES = 20


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given. Large files are read in splits."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter whose count is the same on the most of the first lines."""
    lines = [r["value"] for r in spark.read.text(path).limit(SAMPLE_LINES).collect()]  # a fixed sample
    best, best_key = DELIMITERS[0], (0.0, 0)
    for mark in DELIMITERS:
        counts = [line.count(mark) for line in lines if line.strip()]
        if not counts or max(counts) == 0:
            continue
        common = max(set(counts), key=lambda n: (counts.count(n), n))
        key = (counts.count(common) / len(counts) if common else 0.0, common)
        if key > best_key:
            best, best_key = mark, key
    return best


def without_nul(df: DataFrame) -> DataFrame:
    """Drop NUL characters from all text columns."""
    strings = set(string_columns(df))
    return df.select(
        *[(F.replace(col(c), F.lit("\0"), F.lit("")) if c in strings else col(c)).alias(c) for c in df.columns]
    )


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Delimited text with a detected delimiter; undecodable bytes become replacement characters."""
    reader = spark.read.option("header", True).option("sep", sniff_delimiter(spark, path)).option("mode", "PERMISSIVE")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return without_nul(df)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """JSON lines, read in splits; ``multi_line`` reads one document per file, each in one task."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType, keep: int | None = 2000, time: str = "ts") -> DataFrame:
    """JSON lines; malformed lines are skipped, the newest ``keep`` records stay."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if keep is None else newest(df, keep, time)


def newest(df: DataFrame, keep: int, time: str = "ts", tie: str | None = None) -> DataFrame:
    """The newest ``keep`` records."""
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    return df.orderBy(*order).limit(keep)


def count_rows(spark: SparkSession, path: str) -> int:
    """Data lines of a text table; every file below the path has a header line."""
    return spark.read.option("header", True).csv(path).count()


READERS: dict[str, Callable[..., DataFrame]] = {
    ".csv": read_delimited,
    ".txt": read_delimited,
    ".json": read_json,
    ".parquet": read_parquet,
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Reader by file extension."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind not in READERS:
        raise ValueError(f"unsupported file type: {kind!r}")
    return READERS[kind](spark, path)


def size_text(n: Column) -> Column:
    """Bytes as ``B``, ``KB`` or ``MB``."""
    return (
        F.when(n >= 1_048_576, F.format_string("%.2f MB", F.bround(n / 1_048_576, 2)))
        .when(n >= 1024, F.format_string("%.2f KB", F.bround(n / 1024, 2)))
        .otherwise(F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
    )


def input_size(spark: SparkSession, path: str) -> DataFrame:
    """Total bytes below a path, also as text; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return total.withColumn("size", size_text(F.col("bytes").cast("double")))
