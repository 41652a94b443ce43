"""Vector code compression: integer product codes with per-dimension value dictionaries.

Components become integers. Rows are kept in blocks; a block holds, for every dimension, the distinct integers that occur
(its dictionary) and a code of two bytes for every component. To compare a block with a codebook, the squared difference of
each distinct integer to each entry is tabulated once, and the distance of a part is a gather and an add for each of
its dimensions. All arithmetic is in whole numbers, so a result doesn't depend on the order or the number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.session import checkpointed

#: Integer steps of 1.0, parts of a vector, entries of a codebook, and rounds of assignment and replacement.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a block; its dictionaries can't have more values, so codes fit two bytes.
BLOCK = 8192
#: Components from this size on are refused, so that squared distances stay exact.
LARGEST = 1 << 26


def sound(vector: Column) -> Column:
    """Whether a vector is there, not empty, and holds neither nulls nor NaN nor infinities."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(whole & (F.size(vector) > 0), F.lit(False))


def one_length(df: DataFrame, vector: str, least: int = 1) -> int:
    """The number of components that all vectors share; 0 for an empty table."""
    found = df.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if found["a"] is None:
        return 0
    if found["a"] != found["b"] or found["a"] % least:
        raise ValueError(f"vectors have {found['a']} to {found['b']} components; all must have the same number, a multiple of {least}")
    return int(found["a"])


def whole_numbers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """(rows, size) floors of the scaled components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale).reshape(-1, size)
    if whole.size and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"a component times {scale} reaches {LARGEST}")
    return whole.astype(np.int64)


def _blocks(size: int, scale: int):
    """Rows (key, label, vector) to blocks: keys, labels, dictionary sizes, dictionaries and codes, dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                whole = whole_numbers(part.column(2), size, scale)
                found = [np.unique(whole[:, d], return_inverse=True) for d in range(size)]
                lists = lambda x, t=None: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
                codes = b"".join(codes.astype("<u2").tobytes() for _, codes in found)
                yield pa.RecordBatch.from_arrays([
                    lists(part.column(0)), lists(part.column(1)), lists([len(v) for v, _ in found], pa.int32()),
                    lists(np.concatenate([v for v, _ in found]), pa.int64()), pa.array([codes], pa.binary())], ["keys", "labels", "sizes", "dictionary", "codes"])

    return run


class _Block:
    """A block read again: distances of its rows to the entries of a part, and its integers."""

    def __init__(self, batch: pa.RecordBatch, i: int, names: Sequence[str]):
        at = {n: k for k, n in enumerate(names)}
        sizes = batch.column(at["sizes"])[i].values.to_numpy()
        values = batch.column(at["dictionary"])[i].values.to_numpy()
        self.values = np.split(values, np.cumsum(sizes)[:-1])
        self.codes = np.frombuffer(batch.column(at["codes"])[i].as_py(), "<u2").reshape(len(sizes), -1)

    def distances(self, part: int, book: np.ndarray) -> np.ndarray:
        """(rows, entries) squared distances."""
        total = np.zeros((self.codes.shape[1], len(book)), np.int64)
        for j in range(book.shape[1]):
            d = part * book.shape[1] + j
            table = (self.values[d][:, None] - book[:, j][None, :]) ** 2
            total += table[self.codes[d]]
        return total


def _sums(books: list[list[list[int]]]):
    """Per task and entry: the number of parts that are nearest to it and the sums of their components."""
    arrays = [np.array(b, np.int64) for b in books]
    entries, width = arrays[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(arrays), entries), np.int64)
        sums = np.zeros((len(arrays), entries, width), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, batch.schema.names)
                for p, book in enumerate(arrays):
                    nearest = block.distances(p, book).argmin(axis=1)  # the first of equals
                    counts[p] += np.bincount(nearest, minlength=entries)
                    for j in range(width):
                        d = p * width + j
                        # At most BLOCK values below LARGEST: exact as floating numbers.
                        sums[p, :, j] += np.bincount(nearest, block.values[d][block.codes[d]], entries).astype(np.int64)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()),
             *(pa.array(sums[part, entry, j], pa.int64()) for j in range(width))],
            ["part", "entry", "n", *(f"s{j}" for j in range(width))])

    return run


def _coded(books: list[list[list[int]]]):
    arrays = [np.array(b, np.int64) for b in books]
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, batch.schema.names)
                error, code = np.zeros(block.codes.shape[1], np.int64), np.full(block.codes.shape[1], "", "U1")
                for p, book in enumerate(arrays):
                    d = block.distances(p, book)
                    nearest = d.argmin(axis=1)
                    error += d[np.arange(len(d)), nearest]
                    code = np.char.add(code, digits[nearest])
                keys, labels = (batch.column(batch.schema.names.index(n))[i].values for n in ("keys", "labels"))
                yield pa.RecordBatch.from_arrays([keys, labels, pa.array(code.tolist(), pa.string()), pa.array(error)], ["key", "label", "code", "error"])

    return run


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """Rows (key, label, code, error) of all sound vectors, and the codebooks as integers by part, entry and place.

    Rows whose vector is null, empty, or holds a null, NaN or infinite component are left out. Components are
    floor(scale * x). A part's codebook starts as that part of the ``entries`` smallest keys (null keys last, rows of one
    key by vector); a table of fewer rows has as many entries. Each round assigns all rows to the nearest entry, the lower
    index on ties, and replaces entries by floor(sum / count); entries without rows stay. Repeated rows count each time.
    Vectors of different lengths, of a length that the parts don't divide, and components of 2^26 or more after
    scaling raise ValueError. Other columns are not read; an empty table gives no rows and no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.filter(sound(F.col("vector")))
    size = one_length(rows, "vector", parts)
    key_type, label_type = rows.schema["key"].dataType, rows.schema["label"].dataType
    result = T.StructType([T.StructField("key", key_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not size:
        return df.sparkSession.createDataFrame([], result), []
    stored = T.StructType([
        T.StructField("keys", T.ArrayType(key_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("dictionary", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())])
    blocks = checkpointed(rows.mapInArrow(_blocks(size, scale), stored))

    first = rows.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()  # at most 256 rows
    width = size // parts
    whole = np.floor(np.array([r["vector"] for r in first]) * scale).astype(np.int64)
    books = [whole[:, p * width:(p + 1) * width].tolist() for p in range(parts)]
    summed = T.StructType([T.StructField(n, T.IntegerType()) for n in ("part", "entry")] + [T.StructField(n, T.LongType()) for n in ("n", *(f"s{j}" for j in range(width)))])
    packed = blocks.select("sizes", "dictionary", "codes")
    for _ in range(rounds):
        totals = packed.mapInArrow(_sums(books), summed).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
        for r in totals.collect():  # at most parts x entries rows
            books[r["part"]][r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return blocks.mapInArrow(_coded(books), result), books


def books_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the error summed over all rows of a label, null labels together."""
    coded = checkpointed(coded)
    sums = checkpointed(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
