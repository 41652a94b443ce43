"""Substring deduplication by hashing units of text (lines, paragraphs or sentences of lines).

Units are normalised and digested where they are read. The earliest occurrence of each digest, by document then place, is
found by a pre-aggregated minimum; every later one is a repeat. Neighbouring repeats of a document are joined to a span,
and spans long enough are removed, named by their offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelab.llm import words as W
from tablelab.session import checkpointed

#: Words that a span of repeated units has at least. A passage set into a text loses the sentence it starts in, so this
#: is about half of the 50 words from which on a passage is to be found.
LEAST_WORDS = 25
#: A shorter unit, such as a lone word between two marks, is compared with the words behind it up to so many.
CONTEXT_WORDS = 6
#: Bytes that end a unit.
ENDS = {"line": b"\n", "paragraph": b"", "sentence": b".!?\n"}


def _units(data: np.ndarray, offsets: np.ndarray, unit: str, context: int) -> tuple[np.ndarray, ...]:
    """text, place within it, start, end (bytes), words and two digests of each unit that has words.

    A unit is compared by its words, runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased, in order,
    and one with fewer than ``context`` words also by the words behind it in the text, up to that many.
    """
    w = W.words(data, offsets, W.IN_LETTER_WORD)
    if not len(w.starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none, none
    if unit == "paragraph":  # a line feed after a blank line
        breaks = np.zeros(len(data), bool)
        feeds = np.flatnonzero(data == 10)
        breaks[feeds[1:][np.diff(feeds) == 1]] = True
        breaks[offsets[1:] - 1] = True
    else:
        ends = np.zeros(256, bool)
        ends[list(ENDS[unit])] = True
        breaks = ends[data]
    place = np.cumsum(breaks)[w.starts]
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([at[1:], [len(w.starts)]])
    n = last - at
    within = (np.arange(len(w.starts)) - np.repeat(at, n)).astype(np.uint64)
    text = w.text[at]
    short = np.flatnonzero(n < context)
    places = np.arange(context, dtype=np.uint64)
    near = np.minimum(at[short][:, None] + np.arange(context), len(w.starts) - 1)
    own = (w.text[near] == text[short][:, None]) & (at[short][:, None] + np.arange(context) < len(w.starts))
    digests = []
    with np.errstate(over="ignore"):
        for seed in (0x452821E638D01377, 0x34E90C6CC0AC29B7):
            sums = np.add.reduceat(W.mixed(w.hashes ^ W.mixed(within + np.uint64(seed))), at)
            if len(short):
                sums[short] = (W.mixed(w.hashes[near] ^ W.mixed(places + np.uint64(seed))) * own.astype(np.uint64)).sum(1)
            digests.append(W.mixed(sums + n.astype(np.uint64)).view(np.int64))
    first = np.searchsorted(text, text)
    return text, np.arange(len(text)) - first, w.starts[at], w.ends[last - 1], n, *digests


def _listed(unit: str, context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.chunks(batch.column(2)):
                text, place, start, end, n, one, two = _units(data, offsets, unit, context)
                points = W.code_points(data, offsets)
                rows = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place.astype(np.int32)), pa.array(points[start].astype(np.int32)),
                     pa.array(points[end].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(one), pa.array(two)],
                    ["row", "id", "place", "start", "end", "words", "one", "two"])

    return run


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", least_words: int = LEAST_WORDS, context_words: int = CONTEXT_WORDS) -> DataFrame:
    """One row per span to remove: row, id, start, end, words, first_id.

    ``row`` numbers the rows of ``docs`` as read here, ``id`` is the key, start and end are code points of the original
    text (end exclusive), first_id is the smallest key at which a unit of the span stands first. Units are ranked by
    key, null last, then row, then place in the text; the earliest of equal units stays. Units without words never
    repeat, so null, empty and wordless texts have no spans. Spans with fewer than ``least_words`` words stay in the text.
    ``context_words`` 0 compares every unit by itself.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return _spans(numbered, unit, least_words, context_words)


def _spans(numbered: DataFrame, unit: str, least_words: int, context_words: int) -> DataFrame:
    # The texts are read once; from here on only units go on, with the row numbers they were written with.
    units = checkpointed(numbered.mapInArrow(_listed(unit, context_words), "row long, id long, place int, start int, end int, words int, one long, two long"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row", "place")
    firsts = units.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).filter("n > 1")
    firsts = checkpointed(firsts.select("one", "two", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place")))
    again = units.join(firsts, ["one", "two"]).filter((F.col("row") != F.col("first_row")) | (F.col("place") != F.col("first_place")))
    in_text = Window.partitionBy("row").orderBy("place")
    joined = again.select("row", "id", "start", "end", "words", "first_id", (F.col("place") - F.row_number().over(in_text)).alias("run"))
    spans = joined.groupBy("row", "run").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("first_id").alias("first_id"))
    return spans.filter(F.col("words") >= least_words).drop("run")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", least_words: int = LEAST_WORDS, context_words: int = CONTEXT_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the repeated spans, and ``removed``, an array of (start, end, first_id)
    with the original offsets. A column of the input named removed is replaced; a null text stays null."""
    kept = [c for c in docs.columns if c != "removed"]
    marks = [f"__k{i}" for i in range(len(kept))]
    body = F.col(marks[kept.index(text)])
    rows = checkpointed(docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(m) for c, m in zip(kept, marks)]))
    numbered = rows.select("row", F.col(marks[kept.index(key)]).cast("long").alias("id"), body.alias("text"))
    gone = _spans(numbered, unit, least_words, context_words).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_id"))).alias("removed"))
    joined = rows.join(checkpointed(gone), "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:int,end:int,first_id:bigint>>")))
    # What stays lies between the end of one span and the start of the next.
    froms = F.concat(F.array(F.lit(0)), F.transform("removed", lambda s: s["end"]))
    upto = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.char_length(body)))
    pieces = F.transform(F.arrays_zip(froms.alias("f"), upto.alias("u")), lambda p: F.substring(body, p["f"] + 1, p["u"] - p["f"]))
    clean = F.when(F.size("removed") == 0, body).otherwise(F.array_join(pieces, ""))
    return joined.select(*[(clean if c == text else F.col(m)).alias(c) for c, m in zip(kept, marks)], "removed")
