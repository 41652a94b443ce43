"""Exact duplicates with a heavy-hitter split.

Misra-Gries summaries, one per task, name the digests that may hold more than a given share of all rows. Their exact
counts are then taken, and the confirmed ones, a bounded number of rows, are broadcast: rows with such a digest are
decided where they are read. All other digests are shuffled as usual; none of their groups can be large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelab.session import checkpointed

#: A digest with at least one in so many rows is frequent. At most so many digests can be, which bounds the broadcast.
SHARE = 1024
#: Counters of one task's summary. A task may undercount a digest by one in so many of its rows.
COUNTERS = 4 * SHARE


def merge_counters(counters: pd.Series, counters_more: pd.Series, limit: int) -> pd.Series:
    """Misra-Gries counters of both inputs: counts are added and, if over ``limit`` remain, all are lowered by the first surplus one."""
    both = pd.concat([counters, counters_more]).groupby(level=0, sort=False).sum()
    if len(both) > limit:
        surplus = np.partition(both.to_numpy(), len(both) - limit - 1)[len(both) - limit - 1]
        both = both[both > surplus] - surplus
    return both


def _summary(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = pd.Series(dtype="int64")
        for batch in batches:
            counters = merge_counters(counters, batch["digest"].value_counts(sort=False), limit)
        yield pd.DataFrame({"digest": counters.index.to_numpy(dtype=object), "n": counters.to_numpy(dtype="int64")})

    return run


def frequent(rows: DataFrame, total: int, share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """Digests held by at least one in ``share`` rows and by two or more, with their size and the row that stays."""
    sums = rows.select("digest").mapInPandas(_summary(counters), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    # A true count is at most the sum plus total / (counters + 1), so no frequent digest is missed here, and few others pass.
    able = checkpointed(sums.filter(F.col("n") >= total / share - total / (counters + 1)).select("digest"))
    exact = rows.join(F.broadcast(able), "digest").groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("stays"))
    return checkpointed(exact.filter((F.col("group_size") >= total / share) & (F.col("group_size") > 1)))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text. The row with the largest key stays; a null key is
    below every other, and of rows with both text and key alike exactly one stays. Other columns are not read. An empty
    table gives an empty result.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = checkpointed(docs.select(
        F.col(f"`{key}`").alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    winners = frequent(rows, rows.count(), share, counters)
    marked = rows.join(F.broadcast(winners), "digest", "left")
    heavy = marked.filter(F.col("stays").isNotNull())
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "id", "row", F.count(F.lit(1)).over(group).alias("group_size"), F.max(F.struct("id", "row")).over(group).alias("stays"))
    return heavy.select(rest.columns).unionByName(rest).select(
        F.col("id").alias("doc_id"),
        F.col("stays.id").alias("keep_id"),
        "group_size",
        (F.col("stays.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
