"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions.fixed_values import BLANKS, DATE_FORMATS, NUMBER_PATTERN


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by equal names, one at least, where NULL equals NULL; the key columns of the left side stay."""
    keys = [f"_right_{i}" for i in range(len(on))]
    renamed = right.select(*[col(c).alias(k) for c, k in zip(on, keys)], *[col(c) for c in right.columns if c not in on])
    same = [col(c).eqNullSafe(F.col(k)) for c, k in zip(on, keys)]
    return left.join(renamed, same, how).drop(*keys)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    kinds = (T.StringType, T.CharType, T.VarcharType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def time_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def order_number(df: DataFrame, name: str) -> Column:
    """A double that grows with the column; clock fields, not the session zone, decide for times."""
    c = col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
        return (F.unix_date(c.cast("date")) * F.lit(86400.0) + seconds).cast("double")
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN and the infinities become NULL, so that one notion of missing is left."""
    out = []
    for field in df.schema.fields:
        c = col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
            c = F.when(~bad, c)
        out.append(c.alias(field.name))
    return df.select(*out)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal number gives NULL."""
    text = strip(c)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def to_time(c: Column, formats: Sequence[tuple[str, str]] = DATE_FORMATS) -> Column:
    """Text to timestamp by the first format whose shape fits; other text gives NULL."""
    text = strip(c)
    out = None
    for shape, pattern in formats:
        hit, value = text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Limit to [lo, hi], NULL stays NULL."""
    return F.when(c < F.lit(lo), F.lit(lo)).when(c > F.lit(hi), F.lit(hi)).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def one_of(c: Column, words: Iterable[str]) -> Column:
    return c.isin(list(words))


def map_literal(pairs: dict) -> Column:
    """A literal map for lookups with a handful of fixed keys."""
    flat: list[Column] = []
    for key, value in pairs.items():
        flat += [F.lit(key), value if isinstance(value, Column) else F.lit(value)]
    return F.create_map(*flat)


def first_match(c: Column, families: Sequence[tuple[object, Sequence[str]]], default: object) -> Column:
    """Value of the first family one of whose keywords occurs in ``c``."""
    out = None
    for value, words in families:
        hit = c.rlike("|".join(words))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def banded(c: Column, bands: Sequence[tuple[float, str]], last: str) -> Column:
    """Label of the first band whose upper bound lies above ``c``."""
    out = None
    for bound, label in bands:
        out = F.when(c < bound, F.lit(label)) if out is None else out.when(c < bound, F.lit(label))
    return out.otherwise(F.lit(last))


def rows_from_wide(wide: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry of ``rows``."""
    entries = [F.struct(*[v.alias(n) for v, n in zip(row, names)]) for row in rows]
    return wide.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def one_row(*tables: DataFrame) -> DataFrame:
    """Put several one-row tables side by side."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.agg(*[F.max(col(c)).alias(c) for c in out.columns])
