"""URL filters by dated lists.

A list is a history: at some time an entry is put on it or taken off. Histories become intervals in which an entry is
active, and each capture is joined, as of its fetch time, to the intervals of all names that its address falls under.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.session import checkpointed

#: Both sides are cut at calendar months, so that one join key holds a month of one entry.
SLICE = "month"
_ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def names(url: Column) -> Column:
    """Names that an entry can have to cover an address: its host, each domain above it, and the host with each leading part of the path."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    paths = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths)))


def intervals(history: DataFrame) -> DataFrame:
    """(name, since, until) of dated entries (name, at, listed); until is exclusive and null where the entry stays.

    Of entries for one name and time, one that lists wins. Rows with a null in any column are left out. A long
    history of one name is worked on in slices of time; only the first time of each slice meets the other slices.
    """
    known = history.filter(F.col("name").isNotNull() & F.col("at").isNotNull() & F.col("listed").isNotNull())
    points = checkpointed(known.groupBy("name", "at").agg(F.max("listed").alias("listed")).withColumn("slice", F.trunc("at", SLICE)))
    begins = points.groupBy("name", "slice").agg(F.min("at").alias("begins"))
    after = begins.select("name", "slice", F.lead("begins").over(Window.partitionBy("name").orderBy("slice")).alias("after"))
    within = points.select("name", "at", "listed", "slice", F.lead("at").over(Window.partitionBy("name", "slice").orderBy("at")).alias("next"))
    return within.filter("listed").join(checkpointed(after), ["name", "slice"]).select(
        "name", F.col("at").alias("since"), F.coalesce("next", "after").alias("until"))


def active_entries(captures: DataFrame, history: DataFrame, url: str = "url", at: str = "at") -> DataFrame:
    """All rows and columns of ``captures``, then blocked, n_active and entry.

    blocked: at its fetch time at least one entry that covers the address was active; n_active counts them; entry is the
    longest of their names (ties: the smallest). A row without a host or a time is not blocked. Times are dates
    or timestamps alike on both sides. Rows may repeat; columns of the input named like the added ones are replaced.

    An interval is cut only at the months in which captures fall under its name. Intervals of one name don't overlap, so that
    gives at most one row per interval and one more per name and month of captures, however far apart the dates are.
    """
    kept = [c for c in captures.columns if c not in ("blocked", "n_active", "entry")]
    marks = [f"__k{i}" for i in range(len(kept))]
    address, when = F.col(marks[kept.index(url)]), F.col(marks[kept.index(at)])
    rows = checkpointed(captures.select(*[F.col(f"`{c}`").alias(m) for c, m in zip(kept, marks)], F.monotonically_increasing_id().alias("row")))
    asked = rows.filter(when.isNotNull()).select("row", when.alias("at"), F.trunc(when, SLICE).alias("slice"), F.explode(names(address)).alias("name"))
    months = asked.select("name", "slice").distinct().groupBy("name").agg(F.collect_list("slice").alias("slices"))
    met = lambda s: (s >= F.trunc("since", SLICE)) & (F.col("until").isNull() | (s <= F.trunc("until", SLICE)))
    sliced = checkpointed(intervals(history).join(months, "name").select("name", "since", "until", F.explode(F.filter("slices", met)).alias("slice")))
    held = (
        (asked["name"] == sliced["name"]) & (asked["slice"] == sliced["slice"])
        & (asked["at"] >= sliced["since"]) & (sliced["until"].isNull() | (asked["at"] < sliced["until"])))
    found = asked.join(sliced, held).groupBy("row").agg(
        F.count(F.lit(1)).alias("n_active"), F.min(F.struct((-F.length(asked["name"])).alias("minus"), asked["name"].alias("name"))).alias("best"))
    return rows.join(found, "row", "left").select(
        *[F.col(m).alias(c) for c, m in zip(kept, marks)], F.col("n_active").isNotNull().alias("blocked"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("best.name").alias("entry"))
