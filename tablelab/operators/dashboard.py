"""Chart-ready tables: column roles, group means, shares, boxes, densities, time buckets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions import fixed_values as fixed
from tablelab.functions.columns import (
    boolean_columns, col, null_safe_join, numeric_columns, ratio, rows_from_wide, string_columns, strip, time_columns, to_number, to_time,
)
from tablelab.operators import eda
from tablelab.operators.counts import distinct_over, long_numbers, top_per_group
from tablelab.operators.ranks import EXACT_ROWS, SLICE_ROWS, column_quantiles, grouped_quantiles, ordered_index, running_totals

BOXES = ("q1", "median", "q3")


def _name_is(kind: str, name: str) -> bool:
    return re.search(fixed.ROLE_NAME_PATTERNS[kind], name.lower().strip()) is not None


def column_roles(df: DataFrame) -> dict[str, str]:
    """Role of every column from its name and from one aggregate of its values."""
    rows_needed = [F.count(F.lit(1)).alias("_rows")]
    flags, times = set(boolean_columns(df)), set(time_columns(df))
    numbers, strings = set(numeric_columns(df)), set(string_columns(df))
    for i, c in enumerate(df.columns):
        if c in numbers:
            whole = F.bool_and(col(c).isNull() | ((col(c) % 1 == 0) & (col(c) >= 0) & (col(c) < 20)))
            rows_needed += [F.coalesce(whole, F.lit(True)).alias(f"w{i}")]
        elif c in strings:
            text = strip(col(c))
            rows_needed += [
                F.count(col(c)).alias(f"n{i}"),
                F.count(to_time(text)).alias(f"t{i}"),
                F.count(to_number(text)).alias(f"x{i}"),
            ]
        rows_needed.append(F.hll_sketch_estimate(F.hll_sketch_agg(col(c).cast("string"), 12)).alias(f"a{i}"))
    got = df.agg(*rows_needed).first()
    rows = got["_rows"]
    # Exact distinct counts only where the sketch shows few values.
    few = [(i, c) for i, c in enumerate(df.columns) if (got[f"a{i}"] or 0) <= 100]
    small = df.agg(F.lit(0).alias("_"), *[F.count_distinct(col(c)).alias(f"d{i}") for i, c in few]).first()
    distinct = {c: small[f"d{i}"] for i, c in few}
    filled = {c: got[f"n{i}"] if c in strings else rows for i, c in enumerate(df.columns)}
    id_like = [c for c in df.columns if _name_is("id", c) and c not in distinct]
    is_key = distinct_over(df, {c: rows - 0.5 for c in id_like})
    mostly = distinct_over(df, {c: 0.8 * filled[c] for c in id_like if c in strings})
    wordy = distinct_over(df, {c: min(60, 0.6 * max(filled[c], 1)) for c in strings if c not in distinct})
    out: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        n = distinct.get(c)
        several = n is None or n > 5
        key = is_key.get(c, n == rows)
        role = next((k for k in ("email", "phone", "name", "address", "skip") if _name_is(k, c)), None)
        if role is None and c in flags:
            role = "boolean"
        if role is None and c in numbers:
            if _name_is("id", c) and key:
                role = "id"
            elif n == 2:
                role = "boolean"
            elif n is not None and n <= 15 and got[f"w{i}"]:
                role = "categorical"
            else:
                role = "numeric"
        if role is None and c in times:
            role = "datetime"
        if role is None and c in strings:
            base = max(filled[c], 1)
            time_share, number_share = got[f"t{i}"] / base, got[f"x{i}"] / base
            if _name_is("date", c) and time_share >= 0.5:
                role = "datetime"
            elif several and time_share > 0.7:
                role = "datetime"
            elif number_share > 0.8:
                role = "id" if _name_is("id", c) and key else "boolean" if n == 2 else "numeric"
            elif _name_is("id", c) and (mostly.get(c) if n is None else n > 0.8 * base):
                role = "id"
            elif (wordy.get(c) if n is None else n > min(60, 0.6 * base)) and (n is None or n > 20):
                role = "text"
            else:
                role = "categorical"
        out[c] = role or "categorical"
    return out


def roles_table(df: DataFrame) -> DataFrame:
    roles = column_roles(df)
    return df.sparkSession.createDataFrame(list(roles.items()), "column string, role string")


def role_histogram(df: DataFrame) -> DataFrame:
    return roles_table(df).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def pick_groups(df: DataFrame, roles: dict[str, str] | None = None) -> list[str]:
    """Up to two grouping columns: few distinct values, names like status or type preferred."""
    roles = roles or column_roles(df)
    usable = [c for c, r in roles.items() if r in ("categorical", "boolean")]
    if not usable:
        return []
    over = distinct_over(df, {c: 20.5 for c in usable})
    usable = [c for c in usable if not over[c]]
    if not usable:
        return []
    got = df.agg(*[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(usable)]).first()
    sizes = {c: got[f"d{i}"] for i, c in enumerate(usable)}
    score = lambda c: sizes[c] - (5 if re.search(fixed.PREFERRED_GROUP_PATTERN, c) else 0)
    picked: list[str] = []
    for _ in range(2):
        pool = [c for c in usable if c not in picked and 2 <= sizes[c] <= 12]
        pool = pool or [c for c in usable if c not in picked and roles[c] == "categorical" and sizes[c] <= 20]
        if not pool:
            break
        picked.append(min(pool, key=score))
    return picked


def strongest_pair(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    pairs = eda.correlation_pairs(df, columns)
    return pairs.filter("correlation is not null").orderBy(
        F.desc(F.abs(F.round("correlation", 6))), "column_a", "column_b"
    ).limit(1)


def group_means(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*[col(b) for b in by]).agg(*[F.avg(col(c)).alias(f"avg_{c}") for c in columns])


def top_group_means(df: DataFrame, by: str, column: str, n: int = 10) -> DataFrame:
    return group_means(df, [by], [column]).orderBy(F.desc(f"avg_{column}"), col(by)).limit(n)


def pivot_means(df: DataFrame, rows: str, columns: str, value: str, levels: Sequence[str]) -> DataFrame:
    """Means by two groups with one column per level."""
    return df.groupBy(col(rows)).pivot(columns, list(levels)).agg(F.avg(col(value)))


def group_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*[col(b) for b in by]).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str, levels: Sequence[str]) -> DataFrame:
    out = df.groupBy(col(rows)).pivot(columns, list(levels)).count()
    return out.select(col(rows), *[F.coalesce(col(x), F.lit(0)).alias(x) for x in levels])


def row_shares(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Percent of each pair within its row group."""
    whole = Window.partitionBy(col(rows))
    return group_counts(df, [rows, columns]).withColumn(
        "pct", 100 * ratio(F.col("n"), F.sum("n").over(whole))
    )


def top_categories(df: DataFrame, column: str, n: int = 8, other: str = "Other") -> DataFrame:
    """Values outside the n most frequent ones become ``Other``."""
    counts = df.filter(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("_n"))
    keep = [r[0] for r in counts.orderBy(F.desc("_n"), col(column)).limit(n).collect()]  # n values
    return df.withColumn(column, F.when(col(column).isin(keep), col(column)).otherwise(F.lit(other)))


def value_shares(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts and shares of a column's values."""
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(col(column))).first()[0]
    shares = counts.select("value", "n", ratio(F.col("n"), F.lit(total)).alias("share"))
    return shares if top is None else shares.orderBy(F.desc("n"), "value").limit(top)


def group_histogram(df: DataFrame, by: str, column: str, bins: int = 22, groups: int = 6) -> DataFrame:
    """Histogram per group for the first groups in sorted order, over one common range."""
    first = [r[0] for r in df.select(col(by)).filter(col(by).isNotNull()).distinct().orderBy(col(by)).limit(groups).collect()]
    return eda.histogram(df.filter(col(by).isin(first)), [column], bins, by=[by])


def box_statistics(df: DataFrame, by: str, column: str, top: int | None = 8, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR, extremes and outlier counts per group."""
    base = df.filter(col(column).isNotNull()).select(col(by), col(column).cast("double").alias("_v"))
    if top is not None:
        base = top_categories(base, by, top)
    boxes = grouped_quantiles(base, [by], "_v", [0.25, 0.5, 0.75], BOXES, exact_rows)
    fences = boxes.select(
        col(by).alias("_g"), *BOXES,
        (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lo"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_hi"),
    )
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    return (
        base.join(fences, col(by).eqNullSafe(F.col("_g")))
        .groupBy(col(by), *BOXES)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_v").alias("min"),
            F.max("_v").alias("max"),
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def box_points(df: DataFrame, by: str, column: str, top: int | None = 8, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """The rows drawn beside the boxes: all columns of those beyond the whisker bounds of their group, and which side they are on."""
    base = df.filter(col(column).isNotNull())
    if top is not None:
        base = top_categories(base, by, top)
    values = base.select(col(by), col(column).cast("double").alias("_v"))
    boxes = grouped_quantiles(values, [by], "_v", [0.25, 0.5, 0.75], BOXES, exact_rows)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = boxes.select(col(by), (F.col("q1") - reach).alias("_lo"), (F.col("q3") + reach).alias("_hi"))
    value = col(column).cast("double")
    side = F.when(value < F.col("_lo"), "below").when(value > F.col("_hi"), "above")
    return null_safe_join(base, fences, [by]).withColumn("side", side).filter("side is not null").drop("_lo", "_hi")


def percentile_bar(df: DataFrame, column: str, exact_rows: int = EXACT_ROWS) -> DataFrame:
    return eda.numeric_summary(df, [column], exact_rows).select("column", "min", "q25", "q50", "q75", "max")


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept and r over complete rows; NULL with five rows or fewer."""
    a, b = col(x).cast("double"), col(y).cast("double")
    enough = F.count(F.lit(1)) > 5
    slope = F.try_divide(F.covar_samp(a, b), F.var_samp(a))
    return df.filter(a.isNotNull() & b.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(enough, slope).alias("slope"),
        F.when(enough, F.avg(b) - slope * F.avg(a)).alias("intercept"),
        F.when(enough, eda.safe_corr(a, b)).alias("r"),
    )


def density(
    df: DataFrame, column: str, points: int = 300, bins: int = 2048, standardise: bool = False,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """Gaussian kernel density on a grid between the 1st and 99th percentile, from a fine histogram.

    The bandwidth is Scott's factor times the standard deviation. Rows are first counted into
    ``bins`` cells, so the kernel sum is over cells and not over rows.
    """
    v = col(column).cast("double")
    base = df.filter(v.isNotNull()).select(v.alias("_v"))
    got = base.agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("m"), F.stddev_samp("_v").alias("s"),
                   F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    schema = "column string, x double, density double"
    if got["n"] < 5 or not got["s"] or got["s"] < 1e-9:
        return df.sparkSession.createDataFrame([], schema)
    shift, scale = (got["m"], got["s"]) if standardise else (0.0, 1.0)
    q01, q99 = column_quantiles(base, ["_v"], [0.01, 0.99], exact_rows)["_v"]
    lo, hi = (got["lo"] - shift) / scale, (got["hi"] - shift) / scale
    start, end = (q01 - shift) / scale, (q99 - shift) / scale
    band = got["s"] / scale * got["n"] ** (-1 / 5)
    cell = (hi - lo) / bins
    z = (F.col("_v") - F.lit(shift)) / F.lit(scale)
    cells = (
        base.select(eda.bin_number(z, lo, hi, bins).alias("bin"), z.alias("z"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("center"))
    )
    # At most bins x points products: both numbers are parameters, not data.
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    x = F.lit(start) + F.col("i") * F.lit((end - start) / (points - 1))
    kernel = F.exp(-0.5 * F.pow((x - F.col("center")) / F.lit(band), F.lit(2.0)))
    peak = 1.0 / (got["n"] * band * (2 * 3.141592653589793) ** 0.5)
    return (
        cells.select("n", "center", grid.alias("i"))
        .groupBy("i").agg(F.sum(F.col("n") * kernel).alias("k"))
        .select(F.lit(column).alias("column"), x.alias("x"), (F.col("k") * F.lit(peak)).alias("density"))
    )


def z_scored_boxes(df: DataFrame, columns: Sequence[str], exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Box statistics of z-scored columns and the number of values beyond three deviations."""
    names = list(columns)
    got = df.agg(
        *[e for i, c in enumerate(names) for e in (
            F.avg(col(c).cast("double")).alias(f"m{i}"), F.stddev_samp(col(c).cast("double")).alias(f"s{i}"))]
    ).first()
    scored = df.select(
        *[((col(c).cast("double") - F.lit(got[f"m{i}"])) / F.lit((got[f"s{i}"] or 0.0) + 1e-9)).alias(c)
          for i, c in enumerate(names)]
    )
    quarts = column_quantiles(scored, names, [0.25, 0.5, 0.75], exact_rows)
    wide = scored.agg(
        *[e for i, c in enumerate(names) for e in (
            F.count(col(c)).alias(f"n{i}"), F.count_if(F.abs(col(c)) > 3).alias(f"o{i}"))]
    )
    rows = [
        (F.lit(c), F.col(f"n{i}"), *[F.lit(q).cast("double") for q in quarts[c]], F.col(f"o{i}"))
        for i, c in enumerate(names)
    ]
    return rows_from_wide(wide, rows, ["column", "n", *BOXES, "beyond_3_sigma"])


def value_ranges(df: DataFrame, columns: Sequence[str] | None = None, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Range, IQR and median per column."""
    return eda.numeric_summary(df, columns, exact_rows).select(
        "column", "mean", "std", "min", "q25", F.col("q50").alias("median"), "q75", "max",
        (F.col("max") - F.col("min")).alias("range"), (F.col("q75") - F.col("q25")).alias("iqr"),
    )


def ecdf(df: DataFrame, column: str, rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """Share of the values at or below each distinct value."""
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    run = running_totals(counts, "value", ["n"], rows_per_slice=rows_per_slice)
    return run.select("value", "n", ratio(F.col("n_before") + F.col("n"), F.col("n_total")).alias("cumulative"))


def scaled_group_means(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Group means, min-max scaled per column over the groups."""
    means = long_numbers(df, columns, keep=[by]).groupBy(col(by), "column").agg(F.avg("value").alias("mean"))
    whole = Window.partitionBy("column")
    lo, hi = F.min("mean").over(whole), F.max("mean").over(whole)
    return means.select(col(by), "column", ((F.col("mean") - lo) / (hi - lo + 1e-9)).alias("scaled_mean"))


def mean_intervals(df: DataFrame, by: str, column: str, groups: int = 12) -> DataFrame:
    """Mean with its 95 % interval for the first groups in sorted order; groups of one row are left out."""
    y = col(column).cast("double")
    stats = (
        df.filter(col(by).isNotNull())
        .groupBy(col(by))
        .agg(F.avg(y).alias("mean"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("sem"), F.count(y).alias("n"))
        .orderBy(col(by)).limit(groups)
    )
    return stats.filter("n > 1").select(
        col(by), "mean", "sem", "n",
        (F.col("mean") - 1.96 * F.col("sem")).alias("low"), (F.col("mean") + 1.96 * F.col("sem")).alias("high"),
    )


def _month_spine(buckets: DataFrame, by: Sequence[str], step: str) -> DataFrame:
    """Every bucket between the first and last one of each group."""
    span = buckets.groupBy(*[col(b) for b in by]).agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_z"))
    return span.select(*[col(b) for b in by], F.explode(F.expr(f"sequence(_a, _z, {step})")).alias("bucket"))


def time_means(df: DataFrame, time: str, columns: Sequence[str], by: Sequence[str] = (), unit: str = "month") -> DataFrame:
    """Mean per calendar bucket; buckets without rows are kept with NULL."""
    step = {"month": "interval 1 month", "quarter": "interval 3 months"}[unit]
    buckets = (
        df.filter(col(time).isNotNull())
        .groupBy(*[col(b) for b in by], F.to_date(F.date_trunc(unit, col(time))).alias("bucket"))
        .agg(*[F.avg(col(c).cast("double")).alias(f"avg_{c}") for c in columns], F.count(F.lit(1)).alias("n"))
    )
    spine = _month_spine(buckets, by, step)
    out = null_safe_join(spine, buckets, [*by, "bucket"], "left")
    return out.select(*[col(b) for b in by], "bucket", *[f"avg_{c}" for c in columns], F.coalesce("n", F.lit(0)).alias("n"))


def time_counts(df: DataFrame, time: str, unit: str = "month") -> DataFrame:
    return time_means(df, time, [], unit=unit).select("bucket", "n")


def normalised_trends(df: DataFrame, time: str, columns: Sequence[str], unit: str = "month") -> DataFrame:
    """Bucket means as z-scores per metric."""
    wide = time_means(df, time, columns, unit=unit)
    entries = [F.struct(F.lit(c).alias("metric"), col(f"avg_{c}").alias("value")) for c in columns]
    long = wide.select("bucket", F.explode(F.array(*entries)).alias("e")).select("bucket", "e.metric", "e.value")
    whole = Window.partitionBy("metric")  # one row per bucket and metric
    z = (F.col("value") - F.avg("value").over(whole)) / (F.stddev_samp("value").over(whole) + 1e-9)
    return long.select("bucket", "metric", z.alias("z"))


def time_group_counts(df: DataFrame, time: str, by: str, levels: Sequence[str], unit: str = "quarter") -> DataFrame:
    """Counts per calendar bucket with one column per level, 0 where there are none."""
    base = df.filter(col(time).isNotNull()).withColumn("bucket", F.to_date(F.date_trunc(unit, col(time))))
    out = base.groupBy("bucket").pivot(by, list(levels)).count()
    return out.select("bucket", *[F.coalesce(col(x), F.lit(0)).alias(x) for x in levels])


def missing_bands(df: DataFrame) -> DataFrame:
    """Percent missing per column with its band."""
    pct = F.round("missing_pct", 1)
    return eda.missing_by_column(df).select(
        "column", pct.alias("missing_pct"),
        F.when(pct < 5, F.lit("low")).when(pct > 20, F.lit("high")).otherwise(F.lit("moderate")).alias("band"),
    )


def null_map(df: DataFrame, order: str, ties: Sequence[str] = (), rows: int = 150, columns: int = 20) -> DataFrame:
    """0/1 flags of missing cells for every k-th row in a fixed order, first columns only."""
    total = df.count()
    step = max(1, total // rows)
    names = df.columns[:columns]
    numbered = ordered_index(df, order, ties)
    return numbered.filter((F.col("row_index") - 1) % step == 0).select(
        (F.col("row_index") - 1).alias("row"), *[col(c).isNull().cast("int").alias(f"null_{c}") for c in names]
    )


def key_figures(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """One row: rows, columns, columns per main role, missing percent, duplicates and health."""
    roles = roles or column_roles(df)
    number_of = lambda r: F.lit(sum(1 for x in roles.values() if x == r)).cast("bigint")
    return eda.health(df).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        number_of("numeric").alias("numeric_columns"), number_of("categorical").alias("categorical_columns"),
        number_of("datetime").alias("time_columns"), "missing_pct", "duplicate_rows", "health",
    )
