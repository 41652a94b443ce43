"""Exact ranks, running totals and quantiles that never gather a whole column in one task.

The common idea: cut the value range at sketch quantiles, total each slice, and look inside a
slice only with a window that is partitioned by the slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.functions.columns import col, null_safe_join
from tablelab.session import checkpointed

SLICE_ROWS = 1_000_000
# Up to this many rows a percentile state in one task is both bounded and the fastest way.
EXACT_ROWS = 200_000
#: Slices of one column; beyond that many the slices grow.
MAX_SLICES = 65_536
#: Ranges that rows are dealt out to for their numbers, unless each would hold more than ``SLICE_ROWS`` rows: every range is a task that reports to the driver.
MAX_RANGES = 256
SKETCH_ACCURACY = 10_000
# Below this many values the slack of a bracket would be less than a few ranks; all values are taken.
SMALL_COLUMN = 4 * SKETCH_ACCURACY


def _slices(df: DataFrame, value: str, rows_per_slice: int, rows: int | None = None) -> tuple[DataFrame, bool]:
    """Add ``_slice``: 0 for a small table, else the position among sketch quantiles of ``value``.

    NULL has the slice before all others, as it sorts before all values; NaN falls into the last one. ``rows`` is an upper bound of the table size where the caller knows one.
    """
    rows = df.count() if rows is None else rows
    wanted = min(MAX_SLICES, math.ceil(rows / rows_per_slice))
    if wanted <= 1:
        return df.withColumn("_slice", F.lit(0.0)), False
    points = [i / wanted for i in range(1, wanted)]
    cuts = df.agg(F.percentile_approx(col(value).cast("double"), points, 10 * wanted).alias("c")).first()["c"]
    edges = sorted(set(cuts or []))
    # The slice is a monotone function of the value, so slices are ordered like the values.
    staged = df.withColumn("_point", col(value).cast("double"))
    cutter = Bucketizer(
        splits=[float("-inf")] + edges + [float("inf")], inputCol="_point", outputCol="_slice", handleInvalid="keep"
    )
    cut = cutter.transform(staged).withColumn("_slice", F.when(F.col("_point").isNull(), -1.0).otherwise(F.col("_slice")))
    return cut.drop("_point"), True


def running_totals(
    counts: DataFrame,
    value: str,
    weights: Sequence[str],
    by: Sequence[str] = (),
    rows_per_slice: int = SLICE_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Add ``<w>_before`` and ``<w>_total`` for a table that is unique in (by, value).

    ``<w>_before`` totals the weight of all smaller values in the same group.
    """
    by = list(by)
    sliced, many = _slices(counts, value, rows_per_slice, rows)
    group = [col(b) for b in by]
    if not many:
        w = Window.partitionBy(*group).orderBy(col(value))
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*group)
        return sliced.drop("_slice").select(
            "*",
            *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in weights],
            *[F.sum(x).over(whole).alias(f"{x}_total") for x in weights],
        )
    totals = sliced.groupBy(*group, "_slice").agg(*[F.sum(x).alias(f"_{x}") for x in weights])
    w = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "_slice",
        *[F.coalesce(F.sum(f"_{x}").over(w), F.lit(0)).alias(f"_{x}_offset") for x in weights],
        *[F.sum(f"_{x}").over(Window.partitionBy(*group)).alias(f"{x}_total") for x in weights],
    )
    inner = Window.partitionBy(*group, "_slice").orderBy(col(value)).rowsBetween(Window.unboundedPreceding, -1)
    part = sliced.select("*", *[F.coalesce(F.sum(x).over(inner), F.lit(0)).alias(f"_{x}_inner") for x in weights])
    joined = null_safe_join(part, offsets, [*by, "_slice"])
    return joined.select(
        *[col(c) for c in counts.columns],
        *[(col(f"_{x}_inner") + col(f"_{x}_offset")).alias(f"{x}_before") for x in weights],
        *[col(f"{x}_total") for x in weights],
    )


def ordered_index(
    df: DataFrame,
    order: str,
    ties: Sequence[str] = (),
    by: Sequence[str] = (),
    name: str = "row_index",
    rows_per_slice: int = SLICE_ROWS,
) -> DataFrame:
    """Number the rows of each group from 1 by (order, ties) without one task per group.

    A large table is dealt out by ranges of (group, order, ties) together, so neither a large group nor many rows of
    one order value meet in one task. ``rows_per_slice`` holds up to ``MAX_RANGES`` ranges, then they grow to ``SLICE_ROWS`` rows
    before there are more of them. NULL comes first.
    """
    by = list(by)
    group, places = [col(b) for b in by], [col(order), *[col(t) for t in ties]]
    rows = df.count()
    if rows <= rows_per_slice:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*places)).cast("bigint"))
    ranges = min(math.ceil(rows / rows_per_slice), max(MAX_RANGES, math.ceil(rows / SLICE_ROWS)))
    ranged = df.repartitionByRange(ranges, *group, *places)
    # Ranges come from a sample, so the slice of a row is written before it is used twice.
    sliced = checkpointed(ranged.withColumn("_slice", F.spark_partition_id()))
    inner = Window.partitionBy(*group, "_slice").orderBy(*places)
    w = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    )
    numbered = null_safe_join(sliced.withColumn("_inner", F.row_number().over(inner)), offsets, [*by, "_slice"])
    return numbered.withColumn(name, (F.col("_offset") + F.col("_inner")).cast("bigint")).drop("_offset", "_inner", "_slice")


def key_digest(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[col(k).cast("string") for k in key], F.lit(str(seed))))


def hash_digits(rows: int, rows_per_slice: int) -> int:
    """Leading hex digits of a hash that cut a table into slices, 0 for a small one."""
    return 0 if rows <= rows_per_slice else math.ceil(math.log(rows / rows_per_slice, 16)) + 1


def hash_rank(
    df: DataFrame,
    key: Sequence[str],
    seed: int,
    by: Sequence[str] = (),
    name: str = "hash_rank",
    rows_per_slice: int = SLICE_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Rank rows of each group by md5(key, seed): a repeatable random order.

    The leading hex digits of the hash slice each group evenly, however large it is. ``rows`` is the size of the table where the caller knows it.
    """
    by = list(by)
    group = [col(b) for b in by]
    digest = key_digest(key, seed)
    digits = hash_digits(df.count() if rows is None else rows, rows_per_slice)
    staged = df.withColumn("_hash", digest)
    order = [F.col("_hash"), *[col(k) for k in key]]
    if digits == 0:
        w = Window.partitionBy(*group).orderBy(*order)
        return staged.withColumn(name, F.row_number().over(w).cast("bigint")).drop("_hash")
    staged = staged.withColumn("_slice", F.substring("_hash", 1, digits))
    w = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*group, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    )
    inner = Window.partitionBy(*group, "_slice").orderBy(*order)
    numbered = null_safe_join(staged.withColumn("_inner", F.row_number().over(inner)), offsets, [*by, "_slice"])
    return numbered.withColumn(name, (F.col("_offset") + F.col("_inner")).cast("bigint")).drop("_hash", "_slice", "_offset", "_inner")


def _bracket_points(p: float) -> list[float]:
    slack = 2.0 / SKETCH_ACCURACY
    return [max(0.0, p - slack), min(1.0, p + slack)]


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    exact_rows: int = EXACT_ROWS,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of many columns, as a small record.

    One pass counts and sketches. A small table then takes one exact aggregate. A large one is read twice more: the
    sketch brackets each quantile, the rows below a bracket are counted, and only the values inside are ordered.
    """
    columns = list(columns)
    if not columns:
        return {}
    as_double = df.select(*[col(c).cast("double").alias(c) for c in columns])
    points = [x for p in probs for x in _bracket_points(p)]
    head = as_double.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(col(c), points, SKETCH_ACCURACY).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    record = head.first()
    if record["rows"] <= exact_rows:
        got = as_double.agg(
            *[F.percentile(col(c), [float(p) for p in probs]).alias(f"q{i}") for i, c in enumerate(columns)]
        ).first()
        return {
            c: list(got[f"q{i}"]) if got[f"q{i}"] is not None else [None] * len(probs)
            for i, c in enumerate(columns)
        }
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    wanted = []
    for i, c in enumerate(columns):
        n, sketch = record[f"n{i}"], record[f"s{i}"]
        if not n:
            continue
        for j, p in enumerate(probs):
            position = p * (n - 1)
            lo, hi = (float("-inf"), float("inf")) if n < SMALL_COLUMN else (sketch[2 * j], sketch[2 * j + 1])
            if lo == hi:  # both ranks lie inside the bracket, and it holds a single value
                out[c][j] = lo
                continue
            wanted.append((i, j, c, lo, hi, math.floor(position), math.ceil(position), position - math.floor(position)))
    if not wanted:
        return out
    below = as_double.agg(
        *[F.count_if(col(c) < F.lit(lo)).alias(f"b{k}") for k, (_, _, c, lo, _, _, _, _) in enumerate(wanted)],
        *[F.count_if(col(c).between(lo, hi)).alias(f"i{k}") for k, (_, _, c, lo, hi, _, _, _) in enumerate(wanted)],
    ).first().asDict()
    for k, (i, j, c, _, _, first, last, part) in enumerate(wanted):
        if not below[f"b{k}"] <= first <= last < below[f"b{k}"] + below[f"i{k}"]:  # the sketch was further off than it promises: take all values
            wanted[k] = (i, j, c, float("-inf"), float("inf"), first, last, part)
            below[f"b{k}"], below[f"i{k}"] = 0, record[f"n{i}"]
    # Values inside any bracket; brackets cover about 4 / SKETCH_ACCURACY of the rows each.
    tagged = [
        F.when(col(c).between(lo, hi), F.struct(F.lit(k).alias("k"), col(c).alias("value")))
        for k, (_, _, c, lo, hi, _, _, _) in enumerate(wanted)
    ]
    near = None
    for _, _, c, lo, hi, _, _, _ in wanted:
        hit = col(c).between(lo, hi)
        near = hit if near is None else near | hit
    inside = (
        as_double.filter(near).select(F.explode(F.array_compact(F.array(*tagged))).alias("t"))
        .groupBy("t.k", "t.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(inside, "value", ["n"], by=["k"], rows=sum(below[f"i{k}"] for k in range(len(wanted))))
    offset = F.element_at(F.array(*[F.lit(below[f"b{k}"]) for k in range(len(wanted))]), F.col("k") + 1)
    first = F.element_at(F.array(*[F.lit(x[5]) for x in wanted]), F.col("k") + 1)
    last = F.element_at(F.array(*[F.lit(x[6]) for x in wanted]), F.col("k") + 1)
    start = F.col("n_before") + offset
    hits = ranked.select(
        "k",
        "value",
        ((start <= first) & (first < start + F.col("n"))).alias("is_first"),
        ((start <= last) & (last < start + F.col("n"))).alias("is_last"),
    ).filter("is_first or is_last")
    ends: dict[int, list[float | None]] = {}
    for row in hits.collect():  # at most two rows per column and quantile
        pair = ends.setdefault(row["k"], [None, None])
        if row["is_first"]:
            pair[0] = row["value"]
        if row["is_last"]:
            pair[1] = row["value"]
    for k, (_, j, c, _, _, _, _, part) in enumerate(wanted):
        a, b = ends[k]
        out[c][j] = a + (b - a) * part
    return out


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    exact_rows: int = EXACT_ROWS,
    brackets_from: int = SMALL_COLUMN,
) -> DataFrame:
    """Exact quantiles per group: one row per group, one column per probability.

    Groups with fewer than ``brackets_from`` values order all of them. Above ``exact_rows`` the bracketing of :func:`column_quantiles` runs per group, so that a group
    with a large share of the table is still counted by many tasks.
    """
    by = list(by)
    base = df.select(*[col(b) for b in by], col(value).cast("double").alias("_v")).filter("_v is not null")
    if exact_rows > 0 and base.count() <= exact_rows:
        q = base.groupBy(*[col(b) for b in by]).agg(F.percentile("_v", [float(p) for p in probs]).alias("_q"))
        return q.select(*[col(b) for b in by], *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    points = [x for p in probs for x in _bracket_points(p)]
    sketch = base.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("_rows"), F.percentile_approx("_v", points, SKETCH_ACCURACY).alias("_s")
    )
    brackets = sketch.select(
        *[col(b).alias(f"_g{i}") for i, b in enumerate(by)],
        F.array(*[
            F.struct(
                F.lit(j).alias("j"),
                F.when(F.col("_rows") < brackets_from, float("-inf")).otherwise(F.col("_s")[2 * j]).alias("lo"),
                F.when(F.col("_rows") < brackets_from, float("inf")).otherwise(F.col("_s")[2 * j + 1]).alias("hi"),
                (F.lit(float(p)) * (F.col("_rows") - 1)).alias("pos"),
            )
            for j, p in enumerate(probs)
        ]).alias("_b"),
    )
    same_group = [col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]
    joined = base.join(brackets, same_group).select(*[col(b) for b in by], "_v", "_b")
    # Rows below a bracket collapse to one key per (group, quantile) before the shuffle.
    tagged = F.filter(F.col("_b"), lambda b: F.col("_v") <= b["hi"])
    counts = (
        joined.select(*[col(b) for b in by], "_v", F.explode(tagged).alias("b"))
        .select(
            *[col(b) for b in by],
            F.col("b.j").alias("_j"),
            F.col("b.pos").alias("_pos"),
            F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).otherwise(F.lit(float("-inf"))).alias("_v"),
        )
        .groupBy(*[col(b) for b in by], "_j", "_pos", "_v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(counts, "_v", ["n"], by=[*by, "_j"])
    first, last = F.floor("_pos"), F.ceil("_pos")
    start = F.col("n_before")
    at = lambda r: (start <= r) & (r < start + F.col("n"))
    picked = ranked.groupBy(*[col(b) for b in by]).agg(
        *[
            F.max(F.when((F.col("_j") == j) & at(first), F.col("_v"))).alias(f"_a{j}")
            for j in range(len(probs))
        ],
        *[
            F.max(F.when((F.col("_j") == j) & at(last), F.col("_v"))).alias(f"_z{j}")
            for j in range(len(probs))
        ],
        *[F.max(F.when(F.col("_j") == j, F.col("_pos") - F.floor("_pos"))).alias(f"_f{j}") for j in range(len(probs))],
    )
    ends = [F.col(f"_{x}{j}") for j in range(len(probs)) for x in "az"]
    picked = checkpointed(picked)
    if brackets_from < float("inf") and not picked.filter(F.array_contains(F.array(*[c.isNull() for c in ends]), True)).isEmpty():
        return grouped_quantiles(df, by, value, probs, names, 0, float("inf"))  # a sketch was further off than it promises: order all values
    return picked.select(
        *[col(b) for b in by],
        *[
            (F.col(f"_a{j}") + (F.col(f"_z{j}") - F.col(f"_a{j}")) * F.col(f"_f{j}")).alias(n)
            for j, n in enumerate(names)
        ],
    )


def average_rank(df: DataFrame, value: str, rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """Distinct values with their average rank (ties share the mean of their positions)."""
    counts = df.filter(col(value).isNotNull()).groupBy(col(value)).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, value, ["n"], rows_per_slice=rows_per_slice)
    return ranked.select(col(value), (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*[col(b) for b in by]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
