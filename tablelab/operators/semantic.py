"""Semantic types of string columns: pattern rates, national ids and price parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.columns import col, string_columns, strip
from tablelab.functions.fixed_values import NATIONAL_ID_PATTERNS, SEMANTIC_PATTERNS
from tablelab.functions.texts import price
from tablelab.operators.counts import long_text


def pattern_rates(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.60) -> DataFrame:
    """Share of the filled values that match each pattern: one row per column and pattern."""
    names = list(columns or string_columns(df))
    text = strip(F.col("value"))
    entries = [F.struct(F.lit(n).alias("pattern"), text.rlike(p).alias("hit")) for n, p in SEMANTIC_PATTERNS]
    return (
        long_text(df, names)
        .filter("value is not null")
        .select("column", F.explode(F.array(*entries)).alias("e"))
        .groupBy("column", "e.pattern")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("e.hit").cast("double")), 4).alias("match_rate"))
        .withColumn("matches", F.col("match_rate") >= threshold)
    )


def national_ids(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.50) -> DataFrame:
    """First national id format that at least half of a column's values follow, NULL if none."""
    names = list(columns or string_columns(df))
    text = strip(F.col("value"))
    rates = long_text(df, names).groupBy("column").agg(
        *[
            F.try_divide(F.count_if(text.rlike(p)).cast("double"), F.count("value").cast("double")).alias(n)
            for n, p in NATIONAL_ID_PATTERNS
        ]
    )
    kind = F.coalesce(*[F.when(F.col(n) >= threshold, F.lit(n)) for n, _ in NATIONAL_ID_PATTERNS])
    return rates.select("column", kind.alias("national_id"))


def prices(df: DataFrame, column: str, name: str = "price") -> DataFrame:
    return df.withColumn(name, price(col(column)))
