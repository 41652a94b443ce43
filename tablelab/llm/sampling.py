"""Bounded, repeatable samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.session import checkpointed

#: A text is in no sample if it takes more than this part of an equal share of the bytes for each class.
PART = 4


def longest(max_bytes: int, classes: int) -> int:
    """Bytes of the longest text in a sample of ``max_bytes`` over so many classes."""
    return max_bytes // (PART * max(classes, 1))


def within_bytes(found: pd.DataFrame, group: str, max_bytes: int) -> pd.DataFrame:
    """The first rows of each group, in the order given, whose sizes fit the group's share of ``max_bytes``.

    Shares are equal; what a group doesn't need goes to the others. With no size above ``longest`` every group fills
    three quarters of an equal share or has all its rows.
    """
    left, parts = max_bytes, []
    needs = found.groupby(group)["size"].sum().sort_values(kind="stable")
    for i, (name, need) in enumerate(needs.items()):
        share = min(int(need), left // (len(needs) - i))
        own = found[found[group] == name]
        parts.append(own[own["size"].cumsum() <= share])
        left -= share
    return pd.concat(parts).sort_index() if parts else found


def first_rows(docs: DataFrame, marked: DataFrame, group: str, names: list, per_class: int, max_bytes: int, key: str, text: str) -> pd.DataFrame:
    """Columns id, ``group`` and text of a bounded sample, by id: at most ``per_class`` rows of each group and ``max_bytes`` of text.

    ``marked`` has an id once and its group, one of ``names``. Texts above ``longest`` are left out before rows are
    counted or sizes summed; a group that has no other texts is refused.
    """
    most = longest(max_bytes, len(names))
    body = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sizes = body.select("id", F.octet_length("text").alias("size")).join(marked, "id").groupBy("id", group).agg(F.max("size").alias("size"))
    sizes = checkpointed(sizes.withColumn("order", F.xxhash64(F.col("id").cast("string"))))
    fits = sizes.filter(F.col("size") <= most)
    picks = None
    for name in names:
        own = fits.filter(F.col(group) == name).orderBy("order", "id").limit(per_class)
        picks = own if picks is None else picks.unionByName(own)
    found = (sizes.limit(0) if picks is None else picks).toPandas().sort_values(["order", "id"], kind="stable", ignore_index=True)
    lost = {r[group] for r in sizes.select(group).distinct().collect()} - set(found[group])
    if lost:
        raise ValueError(f"every labelled text of {sorted(lost)} is longer than {most} bytes, a part of max_bytes {max_bytes}")
    chosen = within_bytes(found, group, max_bytes)[["id", group]]
    fields = [sizes.schema["id"], sizes.schema[group]]
    chosen = docs.sparkSession.createDataFrame(list(chosen.itertuples(index=False, name=None)), T.StructType(fields))
    rows = body.filter(F.octet_length("text") <= most).join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("id", group, "text").toPandas()
    return rows.sort_values("id", kind="stable", ignore_index=True)


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column | None, per_class: int, max_bytes: int,
                    key: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """Columns id, text, label (0 or 1) and weight of a bounded sample of the labelled documents.

    At most ``per_class`` rows of each class and ``max_bytes`` of text are taken, in the order of a hash of the key within
    each class, texts above ``longest`` left out; a class with only such texts is refused;
    ``weight`` is how many labelled rows one stands for. Rows without a key or with another label are left out, a key
    labelled twice counts as the larger label, and of documents with one key one is taken.
    """
    marked = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    marked = marked.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    if training is not None:
        marked = marked.filter(training)
    totals = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    rows = first_rows(docs, marked, "label", [0, 1], per_class, max_bytes, key, text)
    counts = rows["label"].value_counts()
    rows["weight"] = pd.Series([totals[x] / counts[x] for x in rows["label"]], dtype=float)
    return rows[["id", "text", "label", "weight"]]
