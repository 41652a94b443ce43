"""Exploratory summaries: per-column statistics, correlations, histograms, health and diagnostics."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions.columns import (
    boolean_columns, col, null_safe_join, numeric_columns, one_row, ratio, rows_from_wide, string_columns, time_columns,
)
from tablelab.operators.counts import long_numbers, long_text, top_per_group, value_counts
from tablelab.operators.moments import pair_correlations
from tablelab.operators.ranks import EXACT_ROWS, SLICE_ROWS, average_rank, column_quantiles, running_totals

CORRELATION_METHODS = ("pearson", "spearman", "kendall")
# Up to this many pairs a built-in aggregate is used, beyond it matrix products.
PAIRS_PER_AGGREGATE = 15


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def column_types(df: DataFrame) -> DataFrame:
    """Column, type name and null count, in table order."""
    kinds = dict(df.dtypes)
    wide = df.agg(*[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = [
        (F.lit(i).cast("bigint"), F.lit(c), F.lit(kinds[c]), F.col(f"m{i}")) for i, c in enumerate(df.columns)
    ]
    return rows_from_wide(wide, rows, ["position", "column", "dtype", "missing"])


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """count, mean, std, min, quartiles, max and missing: one row per numeric column."""
    names = list(columns or numeric_columns(df))
    quarts = column_quantiles(df, names, [0.25, 0.5, 0.75], exact_rows)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            expr
            for i, c in enumerate(names)
            for expr in (
                F.count(col(c)).alias(f"n{i}"),
                F.avg(col(c).cast("double")).alias(f"avg{i}"),
                F.stddev_samp(col(c).cast("double")).alias(f"sd{i}"),
                F.min(col(c)).cast("double").alias(f"lo{i}"),
                F.max(col(c)).cast("double").alias(f"hi{i}"),
            )
        ],
    )
    rows = [
        (
            F.lit(c), F.col(f"n{i}"), F.col(f"avg{i}"), F.col(f"sd{i}"), F.col(f"lo{i}"),
            *[F.lit(q).cast("double") for q in quarts[c]],
            F.col(f"hi{i}"), F.col("rows") - F.col(f"n{i}"),
        )
        for i, c in enumerate(names)
    ]
    return rows_from_wide(wide, rows, ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "missing"])


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, distinct values, top value, its frequency and missing: one row per string column."""
    names = list(columns or string_columns(df))
    counted = long_text(df, names).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("value").isNotNull()
    best = F.min(F.when(filled, F.struct((-F.col("n")).alias("k"), F.col("value").alias("value"))))
    return counted.groupBy("column").agg(
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("count"),
        F.count("value").alias("unique"),
        best["value"].alias("top"),
        (-best["k"]).alias("freq"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("missing"),
    )


def time_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, earliest, latest and missing: one row per time column."""
    names = list(columns or time_columns(df))
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            e
            for i, c in enumerate(names)
            for e in (F.count(col(c)).alias(f"n{i}"), F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}"))
        ],
    )
    clock = "yyyy-MM-dd HH:mm:ss"
    rows = [
        (
            F.lit(c), F.col(f"n{i}"), F.date_format(F.col(f"lo{i}"), clock), F.date_format(F.col(f"hi{i}"), clock),
            F.col("rows") - F.col(f"n{i}"),
        )
        for i, c in enumerate(names)
    ]
    return rows_from_wide(wide, rows, ["column", "count", "min", "max", "missing"])


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are filled; NULL when one side does not vary.

    The running moments of a constant column are exactly 0, so the division gives NULL there.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def _pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    wide = df.agg(*[safe_corr(col(a), col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [(F.lit(a), F.lit(b), F.col(f"r{i}")) for i, (a, b) in enumerate(pairs)]
    return rows_from_wide(wide, rows, ["column_a", "column_b", "correlation"])


def _empty_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "column_a string, column_b string, correlation double")


def ranked(df: DataFrame, columns: Sequence[str], rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """Each column replaced by its average rank; ranks are looked up by value."""
    out = df.select(*[col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        ranks = average_rank(out, c, rows_per_slice).select(col(c).alias("_value"), F.col("avg_rank").alias("_rank"))
        out = out.join(ranks, col(c) == F.col("_value"), "left").select(
            *[F.col("_rank").alias(c) if x == c else col(x) for x in columns]
        )
    return out


def kendall(df: DataFrame, a: str, b: str, rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """Kendall tau-b of one pair, exact, without comparing pairs of rows.

    ``b`` is replaced by its dense rank. For each bit of that rank, rows that agree on all higher
    bits differ in order exactly by this bit, so concordant and discordant pairs follow from
    running totals over ``a``. The work grows with rows times log(distinct values of b).
    """
    grid = (
        df.select(col(a).cast("double").alias("x"), col(b).cast("double").alias("y"))
        .filter("x is not null and y is not null")
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    levels = grid.groupBy("y").agg(F.lit(1).cast("bigint").alias("one"))
    dense = running_totals(levels, "y", ["one"], rows_per_slice=rows_per_slice).select(
        F.col("y").alias("_y"), F.col("one_before").alias("rank"), F.col("one_total").alias("m")
    )
    coded = grid.join(dense, F.col("y") == F.col("_y")).select("x", "rank", "m", "n")
    bits = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.col("m").cast("double"))).cast("int") - 1, F.lit(0)))
    split = coded.select("x", "rank", "n", F.explode(bits).alias("bit")).select(
        "x",
        "bit",
        F.expr("shiftright(rank, bit + 1)").alias("prefix"),
        F.when(F.expr("shiftright(rank, bit) & 1") == 0, F.col("n")).otherwise(F.lit(0)).alias("low"),
        F.when(F.expr("shiftright(rank, bit) & 1") == 1, F.col("n")).otherwise(F.lit(0)).alias("high"),
    )
    per_x = split.groupBy("bit", "prefix", "x").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    run = running_totals(per_x, "x", ["low", "high"], by=["bit", "prefix"], rows_per_slice=rows_per_slice)
    wide_int = "decimal(38,0)"
    pairs = run.agg(
        F.coalesce(F.sum(F.col("high").cast(wide_int) * F.col("low_before")), F.lit(0)).cast("double").alias("concordant"),
        F.coalesce(F.sum(F.col("low").cast(wide_int) * F.col("high_before")), F.lit(0)).cast("double").alias("discordant"),
    )

    def tied(key: str) -> DataFrame:
        n = F.col("n").cast("double")
        return grid.groupBy(key).agg(F.sum("n").alias("n")).agg(
            F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).alias(f"ties_{key}"), F.coalesce(F.sum(n), F.lit(0.0)).alias("rows")
        )

    joined = one_row(pairs, tied("x").drop("rows"), tied("y"))
    all_pairs = F.col("rows") * (F.col("rows") - 1) / 2
    bottom = F.sqrt((all_pairs - F.col("ties_x")) * (all_pairs - F.col("ties_y")))
    tau = F.try_divide(F.col("concordant") - F.col("discordant"), bottom)
    return joined.select(
        F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), tau.alias("correlation"),
        F.col("concordant"), F.col("discordant"),
    )


def correlation_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", rows_per_slice: int = SLICE_ROWS
) -> DataFrame:
    """Upper triangle of the correlation matrix in long form; empty with fewer than two columns."""
    if method not in CORRELATION_METHODS:
        raise ValueError(f"unknown correlation method: {method!r}; use one of {CORRELATION_METHODS}")
    names = list(columns or numeric_columns(df))
    pairs = list(itertools.combinations(names, 2))
    if not pairs:
        return _empty_pairs(df.sparkSession)
    if method == "pearson":
        return pair_correlations(df, names) if len(pairs) > PAIRS_PER_AGGREGATE else _pair_rows(df, pairs)
    if method == "spearman":
        # Ranks are taken over the rows in which both columns are filled, pair by pair when there are gaps.
        gaps = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in names]).first()
        if not any(gaps):
            return _pair_rows(ranked(df, names, rows_per_slice), pairs)
        out = None
        for a, b in pairs:
            part = _pair_rows(ranked(df.filter(col(a).isNotNull() & col(b).isNotNull()), [a, b], rows_per_slice), [(a, b)])
            out = part if out is None else out.unionByName(part)
        return out
    out = None
    for a, b in pairs:
        part = kendall(df, a, b, rows_per_slice).select("column_a", "column_b", "correlation")
        out = part if out is None else out.unionByName(part)
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Full matrix in long form, rounded to four digits; the diagonal is 1 where the column varies."""
    names = list(columns or numeric_columns(df))
    if len(names) < 2:
        return _empty_pairs(df.sparkSession)
    upper = correlation_pairs(df, names, method)
    mirror = F.array(
        F.struct(F.col("column_a").alias("a"), F.col("column_b").alias("b")),
        F.struct(F.col("column_b").alias("a"), F.col("column_a").alias("b")),
    )
    both = upper.select(F.explode(mirror).alias("p"), "correlation").select(
        F.col("p.a").alias("column_a"), F.col("p.b").alias("column_b"), F.round("correlation", 4).alias("correlation")
    )
    wide = df.agg(*[(F.min(col(c)) != F.max(col(c))).alias(f"v{i}") for i, c in enumerate(names)])
    rows = [(F.lit(c), F.lit(c), F.when(F.col(f"v{i}"), F.lit(1.0))) for i, c in enumerate(names)]
    return both.unionByName(rows_from_wide(wide, rows, ["column_a", "column_b", "correlation"]))


def _ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    got = df.agg(
        *[e for i, c in enumerate(columns) for e in (
            F.min(col(c)).cast("double").alias(f"lo{i}"), F.max(col(c)).cast("double").alias(f"hi{i}"))]
    ).first()
    out = {}
    for i, c in enumerate(columns):
        lo, hi = got[f"lo{i}"], got[f"hi{i}"]
        if lo is not None:
            out[c] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    return out


def bin_number(value: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin from 0; the last bin includes its upper edge."""
    width = (hi - lo) / bins
    return F.least(F.floor((value - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")


def histogram(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """Counts per equal-width bin with its edges, empty bins included; one range per column over all groups."""
    names = list(columns or numeric_columns(df))
    ranges = _ranges(df, names) if names else {}
    names = [c for c in names if c in ranges]
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, bin bigint, lower double, upper double, n bigint"
        )
    entries = [
        F.when(
            col(c).isNotNull(),
            F.struct(F.lit(c).alias("column"), bin_number(col(c).cast("double"), *ranges[c], bins).alias("bin")),
        )
        for c in names
    ]
    counted = (
        df.select(*[col(b) for b in by], F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy(*[col(b) for b in by], "e.column", "e.bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The spine has columns x bins rows per group and comes from the counted groups themselves.
    groups = counted.select(*[col(b) for b in by], "column").distinct()
    spine = groups.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    edges = lambda k: F.coalesce(*[
        F.when(F.col("column") == c, F.lit(lo) + (F.col("bin") + k) * F.lit((hi - lo) / bins))
        for c, (lo, hi) in ranges.items()
    ])
    return null_safe_join(spine, counted, [*by, "column", "bin"], "left").select(
        *[col(b) for b in by], "column", "bin", edges(0).alias("lower"), edges(1).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def distributions(df: DataFrame, bins: int = 20, top: int = 10, exact_rows: int = EXACT_ROWS) -> dict[str, DataFrame]:
    """Histogram and moments of numeric columns, top values and distinct counts of string columns."""
    out: dict[str, DataFrame] = {}
    numbers, strings = numeric_columns(df), string_columns(df)
    if numbers:
        out["histogram"] = histogram(df, numbers, bins)
        out["moments"] = numeric_summary(df, numbers, exact_rows).select(
            "column", "mean", F.col("q50").alias("median"), "std"
        )
    if strings:
        out["top_values"] = value_counts(df, strings, top)
        out["unique"] = categorical_summary(df, strings).select("column", "unique")
    return out


def eda_report(
    df: DataFrame,
    *,
    summary: bool = True,
    correlation: bool = True,
    distribution: bool = True,
    method: str = "pearson",
    bins: int = 20,
    top: int = 10,
    exact_rows: int = EXACT_ROWS,
) -> dict[str, DataFrame]:
    """All sections as small DataFrames; sections can be switched off."""
    if not isinstance(df, DataFrame):
        raise TypeError("eda_report() takes a Spark DataFrame")
    if method not in CORRELATION_METHODS:
        raise ValueError(f"unknown correlation method: {method!r}; use one of {CORRELATION_METHODS}")
    if bins < 1 or top < 1:
        raise ValueError("bins and top must be positive")
    out: dict[str, DataFrame] = {"shape": shape(df)} if df.columns else {}
    if df.columns:
        out["columns"] = column_types(df)
    if summary:
        if numeric_columns(df):
            out["numeric"] = numeric_summary(df, exact_rows=exact_rows)
        if string_columns(df):
            out["categorical"] = categorical_summary(df)
        if time_columns(df):
            out["time"] = time_summary(df)
    if correlation and len(numeric_columns(df)) >= 2:
        out["correlation"] = correlation_matrix(df, method=method)
    if distribution:
        out.update(distributions(df, bins, top, exact_rows))
    return out


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and rows that repeat an earlier one."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
    ).withColumn("duplicate_rows", F.col("n_rows") - F.col("unique_rows"))


def missing_cells(df: DataFrame) -> DataFrame:
    """Rows, cells and missing cells of the whole table."""
    total = None
    for c in df.columns:
        one = F.count_if(col(c).isNull())
        total = one if total is None else total + one
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("missing_cells")).withColumn(
        "cells", F.col("n_rows") * len(df.columns)
    )


def health(df: DataFrame) -> DataFrame:
    """Percent of missing cells, percent of duplicate rows and the health score."""
    pct = F.round(F.coalesce(100 * ratio(F.col("missing_cells"), F.col("cells")), F.lit(0.0)), 1)
    dup = F.coalesce(100 * ratio(F.col("duplicate_rows"), F.col("n_rows")), F.lit(0.0))
    joined = one_row(missing_cells(df), duplicate_counts(df).drop("n_rows"))
    return joined.select(
        "n_rows", "missing_cells", "duplicate_rows", pct.alias("missing_pct"), F.round(dup, 4).alias("duplicate_pct"),
        F.greatest(F.lit(0), F.round(100 - pct * 1.5 - F.least(dup, F.lit(20.0)), 0)).cast("bigint").alias("health"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Percent missing per column."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )
    rows = [
        (F.lit(c), F.col(f"m{i}"), F.coalesce(100 * ratio(F.col(f"m{i}"), F.col("rows")), F.lit(0.0)))
        for i, c in enumerate(df.columns)
    ]
    return rows_from_wide(wide, rows, ["column", "missing", "missing_pct"])


def top_missing(df: DataFrame, n: int = 10) -> DataFrame:
    """Columns with gaps, the emptiest first."""
    gaps = missing_by_column(df).filter("missing > 0")
    return gaps.select("column", F.round("missing_pct", 2).alias("missing_pct")).orderBy(
        F.desc("missing_pct"), "column"
    ).limit(n)


def class_shares(df: DataFrame, target: str) -> DataFrame:
    """Share of each class, number of classes and the ratio of the largest to the smallest share."""
    counts = df.filter(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.max("n").alias("hi"), F.min("n").alias("lo")
    ).first()
    share = lambda c: F.round(ratio(c, F.lit(whole["total"])), 4)
    return counts.select(
        "class", "n", share(F.col("n")).alias("share"), F.lit(whole["k"]).cast("bigint").alias("n_classes"),
        F.round(
            share(F.lit(whole["hi"])) / F.greatest(share(F.lit(whole["lo"])), F.lit(1e-9)), 2
        ).alias("imbalance_ratio"),
    )


def sample_skew(c: Column) -> Column:
    """Skewness with the small-sample correction; NULL below three values or without spread."""
    n = F.count(c).cast("double")
    varies = F.min(c) != F.max(c)
    return F.when((n > 2) & varies, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Excess kurtosis with the small-sample correction; NULL below four values or without spread."""
    n = F.count(c).cast("double")
    varies = F.min(c) != F.max(c)
    return F.when((n > 3) & varies, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def target_moments(df: DataFrame, target: str) -> DataFrame:
    y = col(target).cast("double")
    return df.agg(
        F.round(F.avg(y), 4).alias("target_mean"),
        F.round(F.stddev_samp(y), 4).alias("target_std"),
        F.round(sample_skew(y), 4).alias("target_skew"),
        F.round(F.min(y), 4).alias("target_min"),
        F.round(F.max(y), 4).alias("target_max"),
    )


def shape_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Skewness and excess kurtosis per numeric column, with their bands."""
    names = list(columns or numeric_columns(df))
    wide = df.agg(
        *[e for i, c in enumerate(names) for e in (
            sample_skew(col(c).cast("double")).alias(f"s{i}"), sample_kurtosis(col(c).cast("double")).alias(f"k{i}"))]
    )
    band = lambda v, a, b: F.when(F.abs(v) > a, F.lit("high")).when(F.abs(v) > b, F.lit("moderate")).otherwise(
        F.lit("low"))
    rows = [
        (F.lit(c), F.col(f"s{i}"), F.col(f"k{i}"), band(F.col(f"s{i}"), 1.0, 0.5), band(F.col(f"k{i}"), 3.0, 1.0))
        for i, c in enumerate(names)
    ]
    return rows_from_wide(wide, rows, ["column", "skewness", "kurtosis", "skew_band", "kurtosis_band"])


def most_skewed(df: DataFrame, target: str | None = None, n: int = 5) -> DataFrame:
    names = [c for c in numeric_columns(df) if c != target]
    stats = shape_statistics(df, names).select("column", F.round(F.abs("skewness"), 3).alias("abs_skew"))
    return stats.filter("abs_skew is not null").orderBy(F.desc("abs_skew"), "column").limit(n)


def describe_filled(df: DataFrame, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Numeric summary in which undefined figures show as 0."""
    out = numeric_summary(df, exact_rows=exact_rows)
    figures = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return out.select("column", "count", *[F.coalesce(col(f), F.lit(0.0)).alias(f) for f in figures])


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    return {
        "numeric": numeric_columns(df), "text": string_columns(df), "time": time_columns(df),
        "boolean": boolean_columns(df),
    }
