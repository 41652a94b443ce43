"""Windows over past rows that stay cheap when one group holds most of the table.

A long group is cut into chunks of consecutive rows. Each chunk also receives the last rows of the
chunk before it, so every frame that looks back at most ``halo`` rows is complete inside a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.functions.columns import col
from tablelab.operators.ranks import ordered_index

HALO = 200
CHUNK = 100_000


def chunked(
    df: DataFrame, by: Sequence[str], time: str, ties: Sequence[str], halo: int = HALO, chunk: int = CHUNK
) -> DataFrame:
    """Add ``row_index``, ``_chunk`` and ``_extra`` (true for rows that are only context)."""
    rows_per_slice = max(chunk, 1)
    numbered = ordered_index(df, time, ties, by, rows_per_slice=rows_per_slice)
    position = F.col("row_index") - 1
    home = F.floor(position / chunk).cast("bigint")
    near_end = position % chunk >= chunk - halo
    copies = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    spread = numbered.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    return spread.withColumn("_extra", F.col("_home") != F.col("_chunk")).drop("_home")


def frame(by: Sequence[str], first: int, last: int) -> Window:
    return Window.partitionBy(*[col(b) for b in by], "_chunk").orderBy("row_index").rowsBetween(first, last)


def last_values(df: DataFrame, columns: dict[str, str], by: Sequence[str], n: int, gaps: Sequence[str], ring: int = HALO) -> DataFrame:
    """Add the last ``n`` filled values before each row, oldest first: ``columns`` maps source to output.

    A column without gaps takes the n rows before. With gaps, every filled row first lists itself and
    the filled rows before it, the newest such list is carried on, and entries that lie more than
    ``ring`` rows back are left out. Both ways cost n steps per row.
    """
    group = [col(b) for b in by]
    open_columns = [c for c in columns if c in gaps]
    out = df
    for c in open_columns:
        filled = Window.partitionBy(*group, "_chunk", F.col(f"`{c}`").isNull()).orderBy("row_index").rowsBetween(-(n - 1), 0)
        entries = F.collect_list(F.struct(F.col("row_index").alias("i"), col(c).alias("v"))).over(filled)
        out = out.withColumn(f"_own_{c}", F.when(col(c).isNotNull(), entries))
    carry = Window.partitionBy(*group, "_chunk").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    made = {}
    for c, name in columns.items():
        if c in open_columns:
            newest = F.last(F.col(f"_own_{c}"), ignorenulls=True).over(carry)
            near = F.filter(newest, lambda e: e["i"] >= F.col("row_index") - ring)
            made[name] = F.coalesce(F.transform(near, lambda e: e["v"]), F.array().cast(f"array<{dict(df.dtypes)[c]}>"))
        else:
            made[name] = F.collect_list(col(c)).over(frame(by, -n, -1))
    return out.select(*[col(c) for c in df.columns], *[v.alias(k) for k, v in made.items()])


def mean_of(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.try_divide(total, F.size(values).cast("double"))


def std_of(values: Column) -> Column:
    """Sample deviation, NULL below two values."""
    m = mean_of(values)
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    return F.when(F.size(values) >= 2, F.sqrt(squares / (F.size(values) - 1)))


def baseline_of(values: Column) -> Column:
    """Mean of the older half."""
    half = F.greatest(F.lit(1), F.floor(F.size(values) / 2).cast("int"))
    return F.when(F.size(values) > 0, mean_of(F.slice(values, F.lit(1), half)))


def carried_max(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Largest value of all earlier rows of the group, across chunks."""
    group = [col(b) for b in by]
    tops = df.filter(~F.col("_extra")).groupBy(*group, "_chunk").agg(F.max(col(value)).alias("_top"))
    w = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*[col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_chunk").alias("_kc"), F.max("_top").over(w).alias("_before"))
    same = [col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)] + [F.col("_chunk") == F.col("_kc")]
    inner = Window.partitionBy(*group, "_chunk").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    here = df.withColumn("_inner", F.max(F.when(~F.col("_extra"), col(value))).over(inner))
    joined = here.join(before, same)
    keys = [f"_k{i}" for i in range(len(by))]
    return joined.withColumn(name, F.greatest("_inner", "_before")).drop("_inner", "_before", "_kc", *keys)
