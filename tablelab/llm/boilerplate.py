"""Line deduplication by site-relative frequency, in DataFrame operations only.

A line is boilerplate of its site if the pages of the site that hold it, divided by all pages of the site, exceed a
ratio. Both counts are pre-aggregated before they are shuffled, so a site with a third of all pages is no hot key; the
lines to drop go back to the pages by site and digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelab.session import checkpointed

#: Share of a site's pages above which a line is dropped, and the number of pages that must hold it at least.
RATIO, LEAST = 0.1, 3
#: So many lines to drop are broadcast; beyond it the same join is shuffled, where large partitions are split at run time.
BROADCAST_ROWS = 200_000
_HTML_NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def host_of(url: Column) -> Column:
    """Lower-case host of a web address, without user and port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def text_of(html: Column) -> Column:
    """Text of a page with one line for each piece between tags."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _HTML_NOISE, "\n"), r"<[^>]*>", "\n")


def normal(line: Column) -> Column:
    """A line as it is compared: white space trimmed and collapsed."""
    return F.trim(F.regexp_replace(line, r"[\x09-\x0D\x20]+", " "))


def drop_site_lines(pages: DataFrame, site: Column, text: str, ratio: float = RATIO, least: int = LEAST, copies: bool = True) -> DataFrame:
    """``pages`` with ``text`` cleaned, and the columns site, n_lines, n_dropped behind.

    Lines are compared with white space collapsed; blank lines are neither counted nor dropped. A line is dropped,
    wherever it stands, if over ``ratio`` of its site's pages and ``least`` pages or more hold it; the other lines stay
    as they are, in order. A null site is a site of its own; a null text stays null and its page counts. Repeated rows
    are pages each; without ``copies`` pages of a site with one text count as one page, so that a text which is copied
    often doesn't lose its own lines. A column of the input named like an added one is replaced.
    """
    kept = [c for c in pages.columns if c not in ("site", "n_lines", "n_dropped")]
    marks = [f"__k{i}" for i in range(len(kept))]
    body = marks[kept.index(text)]
    named = pages.select(*[F.col(f"`{c}`").alias(m) for c, m in zip(kept, marks)], site.alias("site"), F.monotonically_increasing_id().alias("row"))
    if not copies:
        named = named.withColumn("same", F.unhex(F.md5(body)))
    # One digest for each line, null for a blank one; everything below compares digests.
    rows = checkpointed(named.withColumn("digests", F.transform(
        F.transform(F.split(body, "\n"), normal), lambda x: F.when(x != "", F.unhex(F.md5(x))))))

    held = F.array_distinct(F.array_compact("digests"))
    totals = (rows if copies else rows.select("site", "same").distinct()).groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    counts = rows.select("site", F.explode(held).alias("digest")).groupBy("site", "digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    common = checkpointed(
        counts.join(totals, counts["site"].eqNullSafe(totals["site"])).filter(F.col("n") > F.col("pages") * ratio)
        .select(counts["site"].alias("of"), "digest", "pages"))

    # Lines to drop are listed per page, and only for pages that have some.
    probe = rows.select("site", "row", F.explode(held).alias("digest"), *([] if copies else ["same"]))
    common = F.broadcast(common) if common.count() <= BROADCAST_ROWS else common
    found = probe.join(common, (probe["digest"] == common["digest"]) & probe["site"].eqNullSafe(common["of"])).drop(common["digest"])
    if not copies:  # a line on enough pages may still stand in too few texts
        found = checkpointed(found)
        texts = found.select("of", "digest", "same", "pages").distinct().groupBy("of", "digest", "pages").agg(F.count(F.lit(1)).alias("n"))
        few = texts.filter((F.col("n") < least) | (F.col("n") <= F.col("pages") * ratio)).select(F.col("of").alias("few_of"), F.col("digest").alias("few"))
        found = found.join(few, (found["digest"] == few["few"]) & found["of"].eqNullSafe(few["few_of"]), "left_anti")
    listed = checkpointed(found.groupBy("row").agg(F.collect_set("digest").alias("gone")))
    joined = rows.join(listed, "row", "left")
    stays = F.filter(
        F.arrays_zip(F.split(body, "\n").alias("line"), F.col("digests").alias("digest")),
        lambda x: x["digest"].isNull() | ~F.array_contains("gone", x["digest"]))
    clean = F.when(F.col("gone").isNull(), F.col(body)).otherwise(F.array_join(F.transform(stays, lambda x: x["line"]), "\n"))
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("digests") - F.size(stays))
    return joined.select(
        *[(clean if c == text else F.col(m)).alias(c) for c, m in zip(kept, marks)], "site",
        F.when(F.col(body).isNull(), 0).otherwise(F.size(F.array_compact("digests"))).cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
    )
