"""Near duplicates by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its smallest and its largest, so half the hash
evaluations of minhash are needed. Runs of ``ROWS`` values are band keys. What follows is linear in the members of
buckets, whatever their size:

1. Texts with equal shingle sets are one class; only classes go on.
2. Each bucket has one pivot, the member that shares most buckets with others. All members are compared to it on full
   sets. Pairs that both link to the pivot need no further look, as they are connected.
3. Pairs of a bucket with a member that its pivot didn't link ("strays") are found exactly without listing all pairs: a member
   is described by its difference to the pivot, and two members can only link if these differences overlap in over half
   of the smaller bound below; so a prefix of each difference must share a shingle. Shingles are ordered by how many
   members of the pivot have them, rarest first; those that can't belong to such a pair come before all others. Members that
   share a prefix shingle are candidates if they are few, and again compared on full sets. If they are many, they
   are a bucket of their own, which gets a pivot and goes through steps 2 and 3 again; it is smaller, as its pivot
   leaves it.
4. Connected components over the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelab.llm import words as W
from tablelab.llm.components import components
from tablelab.session import checkpointed

#: Words of a shingle, and the least similarity of a link in percent.
SHINGLE, PERCENT = 5, 80
#: Values of a band. At a similarity of 0.8 two texts share a band with probability 0.8 ** 8 = 0.168, so 63 bands miss one link in 1e5; at 0.85, 37 do.
ROWS = 8
#: Members up to which those that share a prefix shingle are compared with each other.
FEW = 1024
#: Probability at which a link right at the bound may share no band.
MISS = 1e-5


def n_bands(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed for that."""
    return int(np.ceil(np.log(miss) / np.log1p(-((percent / 100) ** rows)))) if percent < 100 else 1


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        drawn = (W.mixed(seeds * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return drawn[:n] | np.uint32(1), drawn[n:]


def signatures(text: np.ndarray, hashes: np.ndarray, n_texts: int, n_permutations: int) -> np.ndarray:
    """(texts, 2 * permutations) smallest and largest value of each permutation; texts without shingles keep zeros."""
    out = np.zeros((n_texts, 2 * n_permutations), np.uint32)
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    multiply, flip = _constants(n_permutations)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    at = bounds[some]
    with np.errstate(over="ignore"):
        for i in range(n_permutations):
            v = (x ^ flip[i]) * multiply[i]
            v ^= v >> np.uint32(16)
            out[some, 2 * i] = np.minimum.reduceat(v, at)
            out[some, 2 * i + 1] = np.maximum.reduceat(v, at)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            k = np.full(len(signature), band + 1, np.uint64)
            for j in range(rows):
                k = W.mixed(k * np.uint64(0x9E3779B97F4A7C15) + signature[:, band * rows + j])
            keys[:, band] = k
    return keys


def _set_digests(text: np.ndarray, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """16 bytes for each set: two sums over differently mixed members, and the size mixed in."""
    bounds = np.searchsorted(text, np.arange(n_texts + 1))
    sizes = np.diff(bounds)
    out = np.zeros((n_texts, 2), np.uint64)
    with np.errstate(over="ignore"):
        for side, seed in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mixed(hashes + np.uint64(seed)))])
            out[:, side] = W.mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64))
    return out


def _sketch(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.chunks(batch.column(1)):
                n = len(offsets) - 1
                text, hashes = W.shingles(W.words(data, offsets, W.IN_SPACED_WORD), shingle)
                sizes = np.bincount(text, minlength=n).astype(np.int64)
                keys = band_keys(signatures(text, hashes, n, -(-bands * rows // 2)), bands, rows)
                filled = sizes > 0
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(np.where(filled, bands, 0))]).astype(np.int32), keys[filled].view(np.int64).ravel())
                digests = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(16), n, [None, pa.py_buffer(np.ascontiguousarray(_set_digests(text, hashes, n)).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(sizes), digests, lists], ["id", "n", "set", "keys"])

    return run


class _Sets:
    """Shingle sets of texts, the last ones kept, as a pivot comes again and again."""

    def __init__(self, shingle: int, keep: int = 64):
        self.shingle, self.keep, self.known = shingle, keep, {}

    def of(self, node: int, text: str | None) -> np.ndarray:
        if node not in self.known:
            if len(self.known) >= self.keep:
                self.known.pop(next(iter(self.known)))
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass") + b"\n", np.uint8)
            self.known[node] = W.shingles(W.words(raw, np.array([0, len(raw)]), W.IN_SPACED_WORD), self.shingle)[1]
        return self.known[node]


def difference_bound(nx: int, nb: int, d: int, percent: int) -> int:
    """Elements that the difference d = |x ^ b| shares at least with that of a partner of x, if the other one of the two is a stray.

    For sets x, y a link means |x ^ y| <= c(x, y) = (100 - percent) / (100 + percent) * (|x| + |y|), and for a stray s
    |s ^ b| > c(s, b). The two differences share (|x ^ b| + |y ^ b| - |x ^ y|) / 2 elements.
    """
    return max(1, -(-(d * (100 + percent) + (100 - percent) * (nb - nx)) // (2 * (100 + percent))))


def long_bound(nx: int, d: int, percent: int) -> int:
    """Elements that the difference of a stray x shares at least with that of any partner."""
    largest = (100 - percent) * (nx + 100 * nx // percent) // (100 + percent)
    return max(1, d - largest)


def _compare(shingle: int, percent: int, differences: bool):
    """For rows (g, a, a_text, b, b_text): sizes, link; with ``differences`` what step 3 needs, for a pivot a and member b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(shingle)
        for batch in batches:
            ids_a, ids_b = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            out, own = [], []
            for i, (a, b) in enumerate(zip(ids_a, ids_b)):
                x, y = sets.of(a, batch.column(2)[i].as_py()), sets.of(b, batch.column(4)[i].as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                link = 100 * common >= percent * (len(x) + len(y) - common)
                d = len(x) + len(y) - 2 * common
                short = d - difference_bound(len(y), len(x), d, percent) + 1
                out.append((len(y), link, d, short, short if link else max(short, d - long_bound(len(y), d, percent) + 1)))
                if differences:
                    own.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
            cols = list(zip(*out)) or [()] * 5
            arrays = [batch.column(0), batch.column(1), batch.column(3), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())))]
            names = ["g", "a", "b", "n", "link", "d", "half", "keep"]
            if differences:
                arrays.append(pa.array(own, pa.list_(pa.int64())))
                names.append("own")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


COMPARED = "g long, a long, b long, n long, link boolean, d long, half long, keep long"


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("g", "a", "a_text", "b", "b_text")


def _heads(compared: DataFrame) -> DataFrame:
    """(g, x, e, n, d, link, half, j): the prefix of each member's difference in groups with a stray, without shingles that no such pair has."""
    loose = compared.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("link").alias("all")).filter((F.col("m") > 1) & ~F.col("all")).select("g")
    elements = compared.join(checkpointed(loose), "g", "left_semi").select("g", F.col("b").alias("x"), "n", "d", "link", "half", "keep", F.explode("own").alias("e"))
    shared = elements.groupBy("g", "e").agg(F.count(F.lit(1)).alias("c"), F.min("link").alias("all")).filter((F.col("c") > 1) & ~F.col("all")).drop("all")
    rarest = Window.partitionBy("g", "x").orderBy("c", "e")  # shingles of one text
    last = F.count(F.lit(1)).over(Window.partitionBy("g", "x"))
    placed = elements.join(shared, ["g", "e"]).withColumn("j", F.col("d") - last + F.row_number().over(rarest) - 1)
    return placed.filter(F.col("j") < F.col("keep")).select("g", "x", "e", "n", "d", "link", "half", "j")


def _candidates(heads: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a prefix shingle and whose sizes and places allow a link."""
    heads = heads.withColumn("short", F.col("j") < F.col("half"))
    left, right = heads.filter("short").alias("l"), heads.filter(~F.col("link")).alias("r")
    smaller, larger = F.least("l.n", "r.n"), F.greatest("l.n", "r.n")
    allowed = F.floor((F.col("l.n") + F.col("r.n")) * (100 - percent) / (100 + percent))
    rest = 1 + F.least(F.col("l.d") - F.col("l.j") - 1, F.col("r.d") - F.col("r.j") - 1)
    able = (
        (F.col("l.g") == F.col("r.g")) & (F.col("l.e") == F.col("r.e")) & (F.col("l.x") != F.col("r.x"))
        & (F.col("l.link") | (F.col("r.short") & (F.col("l.x") < F.col("r.x"))))
        & (100 * smaller >= percent * larger)
        & (F.abs(F.col("l.d") - F.col("r.d")) <= allowed)
        & (2 * rest >= F.col("l.d") + F.col("r.d") - allowed))
    return left.join(right, able).select(F.least("l.x", "r.x").alias("a"), F.greatest("l.x", "r.x").alias("b"))


def _again(heads: DataFrame, many: DataFrame) -> DataFrame:
    """Members of each bucket of ``many``, with the pivot that is in most buckets of its group; buckets of one group and pivot are one."""
    members = heads.join(many, ["g", "e"], "left_semi").select("g", "e", "x")
    weight = members.groupBy("g", "x").agg(F.count(F.lit(1)).alias("weight"))
    pivots = members.join(weight, ["g", "x"]).groupBy("g", "e").agg(F.max(F.struct("weight", (-F.col("x")).alias("minus"))).alias("first"))
    pivots = pivots.select("g", "e", (-F.col("first.minus")).alias("a"))
    return members.join(pivots, ["g", "e"]).filter(F.col("a") != F.col("x")).select(F.xxhash64("g", "a").alias("g"), "a", F.col("x").alias("b")).distinct()


def _links(spokes: DataFrame, texts: DataFrame, shingle: int, percent: int, few: int) -> DataFrame:
    """Links (a, b) that connect what links of pairs within each group of spokes (g, pivot a, member b) connect."""
    links, candidates = [], []
    while True:
        compared = checkpointed(_with_texts(spokes, texts).mapInArrow(_compare(shingle, percent, True), f"{COMPARED}, own array<long>"))
        links.append(compared.filter("link").select("a", "b"))
        heads = checkpointed(_heads(compared))
        sizes = heads.groupBy("g", "e").agg(F.count(F.lit(1)).alias("size"), F.min("link").alias("all")).filter((F.col("size") > 1) & ~F.col("all"))
        many = checkpointed(sizes.filter(F.col("size") > few).select("g", "e"))
        done = many.isEmpty()
        rest = heads if done else heads.join(many, ["g", "e"], "left_anti")
        candidates.append(checkpointed(_candidates(rest, percent).distinct()))
        if done:
            break
        spokes = checkpointed(_again(heads, many))
    pairs = reduce(DataFrame.unionByName, candidates).distinct().withColumn("g", F.lit(0).cast("long"))
    confirmed = _with_texts(pairs, texts).mapInArrow(_compare(shingle, percent, False), COMPARED)
    return reduce(DataFrame.unionByName, links).unionByName(confirmed.filter("link").select("a", "b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    rows: int = ROWS, miss: float = MISS, few: int = FEW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text with fewer words than a shingle has one
    shingle. Texts are linked when 100 * |common| >= percent * |union| on their full sets; null, empty and wordless
    texts have no set and stand alone. component_id is the smallest key that can be reached. Keys are taken to tell
    documents apart: rows with one key are one document if their texts have equal sets, else the component of a row is
    that of its own text. A row with a null key belongs to the component its text reaches, is never its name unless it
    stands alone (then component_id is null), and isn't kept unless so. Other columns are not read.
    """
    bands = n_bands(percent, rows, miss)
    body = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sketched = checkpointed(body.mapInArrow(_sketch(shingle, bands, rows), "id long, n long, set binary, keys array<long>"))

    # 1. A class is named by a number of its own, which is stable once written.
    classes = checkpointed(
        sketched.filter(F.col("n") > 0).groupBy("set").agg(F.min("id").alias("name"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()))

    # 2. Buckets, pivots, comparisons.
    keyed = classes.select("node", F.explode("keys").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    members = checkpointed(keyed.join(checkpointed(sizes), "bucket"))
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("first"))
    pivots = checkpointed(pivots.select("bucket", (-F.col("first.minus")).alias("a")))
    spokes = checkpointed(
        members.select("bucket", F.col("node").alias("b")).join(pivots, "bucket").filter(F.col("a") != F.col("b")).select("a", "b").distinct())

    wanted = spokes.select(F.col("a").alias("node")).unionByName(spokes.select(F.col("b").alias("node"))).distinct()
    owners = classes.select("node", "set", "name").join(wanted, "node")
    # One document of each class lends its text; the digest tells texts of repeated or null keys apart.
    lenders = owners.select(F.col("name").alias("lender")).distinct()
    lent = body.join(lenders, F.col("id").eqNullSafe(F.col("lender")), "left_semi")
    digests = lent.mapInArrow(_digested(shingle), "set binary, text string")
    texts = checkpointed(digests.join(owners.select("set", "node"), "set").dropDuplicates(["node"]).select("node", "text"))

    # 3. Strays.
    links = _links(spokes.withColumn("g", F.col("a")), texts, shingle, percent, few)

    # 4. Components by node; each takes the smallest document of its classes.
    roots = checkpointed(components(links))
    names = checkpointed(classes.select("node", "set", "name").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = checkpointed(names.groupBy("root").agg(F.min("name").alias("component")))
    named = checkpointed(names.join(least, "root").select(F.col("set").alias("of"), "component"))
    out = sketched.select("id", "n", "set").join(named, (F.col("set") == F.col("of")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))


def _digested(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.chunks(batch.column(1)):
                n = len(offsets) - 1
                text, hashes = W.shingles(W.words(data, offsets, W.IN_SPACED_WORD), shingle)
                digests = [row.tobytes() for row in _set_digests(text, hashes, n)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(1).slice(at, n).cast(pa.string())], ["set", "text"])

    return run
