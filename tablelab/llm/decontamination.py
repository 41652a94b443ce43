"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is a run of consecutive item words. To hold a window a document must hold all its words, so the one rarest
word is a necessary prefix: documents are probed with that word alone. Its place in the window gives the only place at
which the window can start; bounds of the document and then the whole window are compared in the join condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.session import checkpointed

#: Words of a window.
WINDOW = 10
#: Fixed value: after A-Z are lower-cased, a word is a run of anything but these.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table with at most so many rows (of a few hundred bytes each) is broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 200_000
#: Document words are probed in strips of so many, each carried with the words around it.
STRIP = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, only A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, GAP), "")


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(window, words, item): every run of ``window`` words of every item; a shorter item is one window."""
    listed = items.select(F.col(f"`{key}`").cast("string").alias("item"), words_of(F.col(f"`{text}`")).alias("all"))
    listed = listed.filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    runs = listed.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words"))
    return runs.select(F.array_join("words", " ").alias("window"), "words", "item").distinct()


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def prefixes(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """For each window its rarest word over all documents (ties: the smaller word, then the earlier place) as token, and that word's place."""
    placed = windows.select("window", "words", F.posexplode("words").alias("place", "token"))
    vocabulary = checkpointed(placed.select("token").distinct())
    n = vocabulary.count()
    counts = checkpointed(texts.select(F.explode("words").alias("token")).join(small(vocabulary, n), "token", "left_semi").groupBy("token").count())
    ranked = placed.join(small(counts, n), "token", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "place")).alias("first"),
        F.first(F.size("words")).alias("length"))
    # A window with a word that no document holds cannot occur.
    return ranked.filter(F.col("first.n") > 0).select("window", "length", "first.token", "first.place")


def occurrences(texts: DataFrame, tokens: DataFrame, n_tokens: int, window: int) -> DataFrame:
    """(row, start, length, window): all places at which a window occurs. Texts are read once and never shuffled if the tokens are few."""
    reach = window - 1
    strip = lambda at: F.struct(
        F.greatest(at - reach, F.lit(0)).alias("from"), at.alias("at"),
        F.slice("words", F.greatest(at - reach, F.lit(0)) + 1, at - F.greatest(at - reach, F.lit(0)) + STRIP + reach).alias("near"))
    strips = texts.filter(F.size("words") > 0).select(
        "row", "n_words", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_words") - 1, F.lit(STRIP)), strip)).alias("s"))
    probes = strips.select("row", "n_words", "s.from", "s.at", "s.near", F.posexplode(
        F.slice("s.near", F.col("s.at") - F.col("s.from") + 1, STRIP)).alias("step", "word"))
    start = F.col("at") + F.col("step") - F.col("place")
    holds = (
        (F.col("word") == F.col("token")) & (start >= 0) & (start + F.col("length") <= F.col("n_words"))
        & (F.array_join(F.slice("near", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.col("length")), " ") == F.col("window")))
    found = probes.join(small(tokens, n_tokens), holds)
    return found.select("row", start.alias("start"), "length", "window")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns of ``docs`` without the text, one row for each of its rows, then n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside an occurrence of any window counts as hit, once. Null or wordless texts have no words and are
    never hit; wordless items have no windows; equal items each count; an item
    without an id hits words but isn't listed. Rows are told apart even if keys repeat or are null.
    """
    kept = [c for c in docs.columns if c != text]
    marks = [f"__k{i}" for i in range(len(kept))]
    texts = checkpointed(docs.select(
        *[F.col(f"`{c}`").alias(m) for c, m in zip(kept, marks)], F.monotonically_increasing_id().alias("row"),
        words_of(F.col(f"`{text}`")).alias("words")).withColumn("n_words", F.size("words")))
    windows = checkpointed(item_windows(items, item_key, item_text, window))
    tokens = checkpointed(prefixes(windows.select("window", "words").distinct(), texts))
    hits = checkpointed(occurrences(texts, tokens, tokens.count(), window))

    order = Window.partitionBy("row").orderBy("start", "end")
    spans = hits.select("row", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_hit = spans.select("row", F.greatest(F.col("end") - F.greatest("start", before), F.lit(0)).alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    of_item = hits.select("row", "window").distinct().join(windows.select("window", "item"), "window")
    found = of_item.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = texts.select(*marks, "row", "n_words").join(n_hit, "row", "left").join(found, "row", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *[F.col(m).alias(c) for c, m in zip(kept, marks)],
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
