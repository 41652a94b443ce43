"""Repeatable splits, folds and samples from hash ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.functions.columns import col, null_safe_join
from tablelab.operators.ranks import SLICE_ROWS, hash_digits, hash_rank, key_digest
from tablelab.session import checkpointed

#: Sizes of up to so many slices go to every task.
FEW_SLICES = 100_000


def _class_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("_size"))


def split(
    df: DataFrame,
    key: Sequence[str],
    shares: Sequence[tuple[str, float]] = (("train", 0.8), ("test", 0.2)),
    by: Sequence[str] = (),
    seed: int = 42,
    name: str = "part",
    rows_per_slice: int = SLICE_ROWS,
) -> DataFrame:
    """Name the part of each row; every class is cut at the same shares.

    Of a large table only the slices of hashes that a cut goes through are ranked row by row; the others lie on one side of
    it, which follows from the sizes of the slices, so their rows stay where they are.
    """
    by, rows = list(by), df.count()

    def part(rank: Column, size: Column) -> Column:
        out, total = None, 0.0
        for label, share in shares[:-1]:
            total += share
            hit = rank <= F.round(size * F.lit(total))
            out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
        return out.otherwise(F.lit(shares[-1][0]))

    columns, group = [col(c) for c in df.columns], [col(b) for b in by]
    digits = hash_digits(rows, rows_per_slice)
    if digits == 0:
        ranked = hash_rank(df, key, seed, by, "_rank", rows_per_slice, rows)
        if by:
            ranked = null_safe_join(ranked, _class_sizes(df, by), by)
        size = F.col("_size") if by else F.lit(rows)
        return ranked.select(*columns, part(F.col("_rank"), size).alias(name))
    staged = df.withColumn("_hash", key_digest(key, seed)).withColumn("_slice", F.substring("_hash", 1, digits))
    counts = staged.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_slice"))
    sized = counts.select(*group, "_slice", "_n", upto.alias("_upto"), F.sum("_n").over(Window.partitionBy(*group)).alias("_size"))
    ends = sized.withColumn("_name", part(F.col("_upto") - F.col("_n") + 1, F.col("_size"))).withColumn("_last", part(F.col("_upto"), F.col("_size")))
    slices = checkpointed(ends.select(*group, "_slice", "_size", (F.col("_upto") - F.col("_n")).alias("_before"), "_name", (F.col("_name") != F.col("_last")).alias("_cut")))
    placed = null_safe_join(staged, F.broadcast(slices) if slices.count() <= FEW_SLICES else slices, [*by, "_slice"])
    inner = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy("_hash", *[col(k) for k in key]))
    whole = placed.filter(~F.col("_cut")).select(*columns, F.col("_name").alias(name))
    ranked = placed.filter("_cut").withColumn("_rank", inner + F.col("_before"))
    return whole.unionByName(ranked.select(*columns, part(F.col("_rank"), F.col("_size")).alias(name)))


def three_way(df: DataFrame, key: Sequence[str], by: Sequence[str] = (), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """70 / 10 / 20 split and its report: rows per part and class."""
    out = split(df, key, (("train", 0.7), ("validation", 0.1), ("test", 0.2)), by, seed)
    return out, out.groupBy("part", *[col(b) for b in by]).agg(F.count(F.lit(1)).alias("n"))


def folds(
    df: DataFrame, key: Sequence[str], k: int = 3, by: Sequence[str] = (), seed: int = 42, name: str = "fold",
    rows_per_slice: int = SLICE_ROWS,
) -> DataFrame:
    """Fold number from 0; sizes differ by at most one row per class."""
    ranked = hash_rank(df, key, seed, by, "_rank", rows_per_slice)
    return ranked.withColumn(name, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def downsample(df: DataFrame, key: Sequence[str], n: int, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """About ``n`` rows with the class shares of the table; the table itself when it is smaller."""
    rows = df.count()
    if rows <= n:
        return df
    return split(df, key, (("keep", n / rows), ("rest", 1 - n / rows)), by, seed).filter("part = 'keep'").drop("part")


def sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in hash order."""
    digest = F.md5(F.concat_ws("|", *[col(k).cast("string") for k in key], F.lit(str(seed))))
    return df.orderBy(digest, *[col(k) for k in key]).limit(n)
