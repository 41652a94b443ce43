import math

import numpy as np
import pytest
from pyspark.sql import types as T

from tablelab.llm.vector_codes import books_digest, vector_codes, with_label_error

INF = float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows, *more):
        fields = [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                  *(T.StructField(n, T.StringType()) for n in more)]
        return spark.createDataFrame(rows, T.StructType(fields))

    return make


def expected(rows, scale, parts, entries, rounds):
    """The contract in plain Python, row by row."""
    kept = [(k, [math.floor(scale * x) for x in v], label) for k, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            for i in range(len(books[p])):
                own = [cut(v, p) for _, v, _ in kept if nearest(v, p)[1] == i]
                if own:
                    new[p][i] = [sum(c) // len(own) for c in zip(*own)]
        books = new
    out = []
    for k, v, label in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((k, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("entries", [3, 16])
def test_same_as_brute_force(vectors, entries):
    draw = np.random.default_rng(5)
    rows = [(i * 3 % 101, [float(np.float32(x)) for x in draw.normal(size=8) * 0.3], int(i % 4) if i % 5 else None) for i in range(90)]
    rows += [(200 + i, [0.25] * 8, 1) for i in range(60)]  # a group of copies
    rows += [(7, [0.5] * 8, 2), (None, [-0.5] * 8, None), (300, None, 1), (301, [], 1), (302, [None] * 8, 1), (303, [0.1] * 7 + [math.nan], 1), (304, [INF] + [0.0] * 7, 1)]
    got, books = vector_codes(vectors(rows), scale=64, parts=4, entries=entries, rounds=3)
    want, want_books = expected(rows, 64, 4, entries, 3)
    assert books == want_books
    assert sorted(map(repr, [(r.key, r.label, r.code, r.error) for r in got.collect()])) == sorted(map(repr, want))
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert {(r.label, r.label_error) for r in with_label_error(got).collect()} == set(sums.items())


def test_few_rows_empty_tables_and_clashing_names(vectors):
    got, books = vector_codes(vectors([(2, [1.0] * 8, 1, "x", "y"), (1, [-1.0] * 8, 1, "x", "y")], "code", "keys"))
    assert books == [[[-4096], [4096]]] * 8
    assert sorted((r.key, r.code, r.error) for r in got.collect()) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]
    got, books = vector_codes(vectors([(1, None, None)]))
    assert got.collect() == [] and books == [] and with_label_error(got).collect() == []
    assert len(books_digest(books)) == 64


def test_refused(vectors):
    for rows in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 7, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(Exception, match="components|reaches"):
            vector_codes(vectors(rows))[0].collect()
