"""Basic cleaning: names, fills, duplicates, types and outliers as one fitted plan."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelab.functions.columns import clamp, col, normalize_nulls, numeric_columns, string_columns, to_number, to_time
from tablelab.operators.counts import modes
from tablelab.operators.ranks import EXACT_ROWS, column_quantiles
from tablelab.session import checkpointed


def standard_names(columns: Sequence[str]) -> list[str]:
    """Lower-case identifiers; a repeated name gets ``_2``, ``_3`` and so on."""
    taken: set[str] = set()
    out = []
    for name in columns:
        base = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", name.strip().lower())).strip("_") or "col"
        unique, k = base, 1
        while unique in taken:
            k += 1
            unique = f"{base}_{k}"
        taken.add(unique)
        out.append(unique)
    return out


def standardise_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names = standard_names(df.columns)
    return df.toDF(*names), {a: b for a, b in zip(df.columns, names) if a != b}


def training_names(columns: Sequence[str]) -> list[str]:
    """Names for training tables: blanks become ``_``, other signs go, case stays."""
    return [re.sub(r"[^A-Za-z0-9_]", "", re.sub(r"\s+", "_", c.strip())) for c in columns]


def fit_numeric_fill(df: DataFrame, exact_rows: int = EXACT_ROWS) -> dict[str, float]:
    """Median of every numeric column that has nulls; all-null columns are left alone."""
    names = numeric_columns(df)
    if not names:
        return {}
    gaps = df.agg(
        *[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
    ).first()
    open_names = [c for i, c in enumerate(names) if gaps[f"m{i}"] and gaps[f"n{i}"]]
    return {c: q[0] for c, q in column_quantiles(df, open_names, [0.5], exact_rows).items()}


def fit_text_fill(df: DataFrame) -> dict[str, str]:
    """Mode of every string column that has nulls; all-null columns are left alone."""
    names = string_columns(df)
    if not names:
        return {}
    gaps = df.agg(*[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return modes(df, [c for i, c in enumerate(names) if gaps[f"m{i}"]])


def fit_types(df: DataFrame) -> dict[str, str]:
    """``number`` or ``time`` for string columns in which every value parses as one."""
    names = string_columns(df)
    if not names:
        return {}
    got = df.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.count(to_number(col(c))).alias(f"x{i}") for i, c in enumerate(names)],
        *[F.count(to_time(col(c))).alias(f"t{i}") for i, c in enumerate(names)],
    ).first()
    out = {}
    for i, c in enumerate(names):
        n = got[f"n{i}"]
        if n and got[f"x{i}"] == n:
            out[c] = "number"
        elif n and got[f"t{i}"] == n:
            out[c] = "time"
    return out


def fit_clips(
    df: DataFrame, factor: float = 1.5, exact_rows: int = EXACT_ROWS, columns: Sequence[str] | None = None
) -> dict[str, list[float]]:
    """[Q1 - k IQR, Q3 + k IQR] per numeric column with a spread."""
    out = {}
    for c, (q1, q3) in column_quantiles(df, columns or numeric_columns(df), [0.25, 0.75], exact_rows).items():
        if q1 is not None and q3 - q1 != 0:
            out[c] = [q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)]
    return out


def apply_fill(df: DataFrame, fills: dict) -> DataFrame:
    kinds = dict(df.dtypes)

    def filled(c: str) -> Column:
        if c not in fills:
            return col(c)
        whole = kinds[c] in ("tinyint", "smallint", "int", "bigint") and not float(fills[c]).is_integer()
        return F.coalesce(col(c).cast("double") if whole else col(c), F.lit(fills[c]).cast("double" if whole else kinds[c]))

    return df.select(*[filled(c).alias(c) for c in df.columns])


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    convert = {"number": to_number, "time": to_time}
    return df.select(*[(convert[types[c]](col(c)) if c in types else col(c)).alias(c) for c in df.columns])


def apply_clips(df: DataFrame, clips: dict[str, list[float]]) -> DataFrame:
    return df.select(
        *[(clamp(col(c).cast("double"), *clips[c]) if c in clips else col(c)).alias(c) for c in df.columns]
    )


@dataclass
class BasicCleaning:
    """Decisions of one fit. Order of use: names, numeric fill, text fill, duplicates, types, clips."""

    names: list[str] | None = None
    numeric_fill: dict[str, float] = field(default_factory=dict)
    text_fill: dict[str, str] = field(default_factory=dict)
    drop_duplicates: bool = True
    types: dict[str, str] = field(default_factory=dict)
    clips: dict[str, list[float]] = field(default_factory=dict)

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        *,
        standardise: bool = True,
        fill_numeric: bool = True,
        fill_text: bool = True,
        duplicates: bool = True,
        correct_types: bool = True,
        clip_outliers: bool = True,
        iqr_factor: float = 1.5,
        exact_rows: int = EXACT_ROWS,
    ) -> BasicCleaning:
        plan = cls(names=standard_names(df.columns) if standardise else None, drop_duplicates=duplicates)
        if not df.columns:
            return plan
        out = normalize_nulls(df.toDF(*plan.names) if standardise else df)
        if fill_numeric:
            plan.numeric_fill = fit_numeric_fill(out, exact_rows)
            out = apply_fill(out, plan.numeric_fill)
        if fill_text:
            plan.text_fill = fit_text_fill(out)
            out = apply_fill(out, plan.text_fill) if plan.text_fill else out
        if duplicates:
            # The passes below read the table several times; the duplicates are found once.
            out = checkpointed(out.dropDuplicates()) if correct_types or clip_outliers else out
        if correct_types:
            plan.types = fit_types(out)
            out = apply_types(out, plan.types)
        if clip_outliers:
            plan.clips = fit_clips(out, iqr_factor, exact_rows)
        return plan

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.toDF(*self.names) if self.names else df
        if not out.columns:
            return out
        out = normalize_nulls(out)
        fills = {**self.numeric_fill, **self.text_fill}
        if fills:
            out = apply_fill(out, fills)
        if self.drop_duplicates and not out.isStreaming:
            out = out.dropDuplicates()
        return apply_clips(apply_types(out, self.types), self.clips)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, record: dict) -> BasicCleaning:
        return cls(**record)


def clean(df: DataFrame, **options) -> tuple[DataFrame, dict]:
    """Fit and apply; returns the cleaned table and a summary record."""
    if not isinstance(df, DataFrame):
        raise TypeError("clean() takes a Spark DataFrame")
    plan = BasicCleaning.fit(df, **options)
    out = plan.transform(df)
    renamed = {a: b for a, b in zip(df.columns, plan.names or df.columns) if a != b}
    summary = {"renamed": renamed, "rows_before": 0, "rows_after": 0, "duplicates_removed": 0,
               "numeric_filled": {}, "text_filled": {}, "types": plan.types, "clipped": {}}
    if not df.columns:
        return out, summary
    base = normalize_nulls(df.toDF(*plan.names) if plan.names else df)
    counts = base.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(col(c).isNull()).alias(f"f_{c}") for c in [*plan.numeric_fill, *plan.text_fill]],
    ).first()
    summary["rows_before"] = counts["_rows"]
    summary["numeric_filled"] = {c: counts[f"f_{c}"] for c in plan.numeric_fill}
    summary["text_filled"] = {c: counts[f"f_{c}"] for c in plan.text_fill}
    # Values moved by the clip are counted on the table just before it.
    unclipped = BasicCleaning(**{**plan.to_dict(), "clips": {}}).transform(df)
    after = unclipped.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.count_if((col(c) < lo) | (col(c) > hi)).alias(f"c{i}")
            for i, (c, (lo, hi)) in enumerate(plan.clips.items())
        ],
    ).first()
    summary["rows_after"] = after["_rows"]
    summary["duplicates_removed"] = counts["_rows"] - after["_rows"]
    summary["clipped"] = {c: after[f"c{i}"] for i, c in enumerate(plan.clips) if after[f"c{i}"]}
    return out, summary
