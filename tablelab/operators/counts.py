"""Value counts, modes and distinct counts for many columns in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.columns import col
from tablelab.operators.ranks import top_per_group


def long_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows, values as text."""
    return df.select(*[col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], [col(c) for c in columns], "column", "value"
    )


def long_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) rows, values as double."""
    wide = df.select(*[col(k) for k in keep], *[col(c).cast("double").alias(f"_v_{c}") for c in columns])
    entries = [F.struct(F.lit(c).alias("column"), col(f"_v_{c}").alias("value")) for c in columns]
    return wide.select(*[col(k) for k in keep], F.explode(F.array(*entries)).alias("e")).select(
        *[col(k) for k in keep], "e.column", "e.value"
    )


def value_counts(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Counts of the values of each column; ties by value, so the order never depends on the input."""
    counted = (
        long_text(df, columns).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    if top is None:
        return counted
    return top_per_group(counted, ["column"], [F.desc("n"), F.asc("value")], top)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, smallest value on ties."""
    if not columns:
        return {}
    best = value_counts(df, columns).groupBy("column").agg(F.min(F.struct(-F.col("n"), F.col("value"))).alias("b"))
    return {r["column"]: r["b"]["value"] for r in best.collect()}  # one row per column


def distinct_over(df: DataFrame, limits: Mapping[str, float]) -> dict[str, bool]:
    """Whether a column has more distinct values than its limit.

    A sketch settles the clear cases; only columns close to their limit are counted exactly.
    """
    names = list(limits)
    if not names:
        return {}
    near = df.agg(
        *[
            F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(col(c).cast("string"), 12)), F.lit(0)).alias(f"d{i}")
            for i, c in enumerate(names)
        ]
    ).first()
    out: dict[str, bool] = {}
    open_cases: list[str] = []
    for i, c in enumerate(names):
        estimate, limit = near[f"d{i}"], limits[c]
        if estimate > 1.2 * limit + 10:
            out[c] = True
        elif estimate < 0.8 * limit - 10:
            out[c] = False
        else:
            open_cases.append(c)
    if open_cases:
        exact = df.agg(*[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(open_cases)]).first()
        for i, c in enumerate(open_cases):
            out[c] = exact[f"d{i}"] > limits[c]
    return out
