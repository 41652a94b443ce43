import random

import numpy as np
import pyarrow as pa
import pytest

from tablelab.llm import minmax
from tablelab.llm import words as W
from tablelab.llm.components import components
from tablelab.llm.minmax import near_duplicates, signatures


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def expected(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(keys) if keys else None
        out.append((key, len(sets[i]), least, key == least))
    return sorted(out, key=repr)


def got(docs, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, **more).collect()), key=repr)


def edited(base, n, draw):
    w = base.split()
    for _ in range(n):
        w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("size, percent, few", [(3, 85, 1024), (5, 80, 1024), (5, 80, 8)])
def test_clusters_around_the_bound(documents, size, percent, few):
    """Copies with few edits, many of them just below the bound to the cluster's middle but linked to each other."""
    draw = random.Random(size)
    base = " ".join(f"w{draw.randrange(500)}" for _ in range(120))
    rows = [(1000 + i, edited(base, draw.randrange(0, 9), draw)) for i in range(120)]
    far = edited(base, 7, draw)
    rows += [(2000 + i, edited(far, draw.randrange(0, 5), draw)) for i in range(40)]
    draw.shuffle(rows)
    assert got(documents(rows), shingle=size, percent=percent, few=few) == expected(rows, size, percent)


def test_unlinked_members_of_a_pivot_are_not_all_compared(spark, documents, monkeypatch):
    """Texts around one base, none linked to another: candidates grow with their number, not with its square."""
    draw = random.Random(8)
    base = " ".join(f"w{draw.randrange(5000)}" for _ in range(150))
    made = []
    candidates = minmax._candidates
    monkeypatch.setattr(minmax, "_candidates", lambda *a: made.append(candidates(*a)) or made[-1])
    for n in (100, 200):
        rows = [(i, edited(base, draw.randrange(12, 20), draw)) for i in range(n)]
        made.clear()
        assert got(documents(rows)) == expected(rows, 5, 80)
        assert sum(m.count() for m in made) < 10 * n


def test_odd_texts(documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "É two three four"), (9, "é two three four"), (10, "a b c d"),
            (11, "word " * 50_000), (12, "word " * 70_000), (12, "word " * 70_000), (None, "word " * 9), (None, "lonely words here only"), (13, "x y z"), (13, "p q r s")]
    rows += [(100 + i, "the very same text again and again") for i in range(50)]
    assert got(documents(rows), shingle=3, percent=85) == expected(rows, 3, 85)


def test_empty_and_clashing(documents):
    assert got(documents([])) == []
    docs = documents([(2, "a b c d e f", "x", "y"), (1, "a b c d e f", "x", "y")], "node", "set")
    assert got(docs) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_signature_is_unbiased():
    """Minimum and maximum agree about as often as the sets overlap."""
    draw = np.random.default_rng(1)
    pool = W.mixed(draw.integers(0, 2**63, 1500).astype(np.uint64))
    text = np.repeat([0, 1], 1000)
    s = signatures(text, np.concatenate([np.sort(pool[:1000]), np.sort(pool[500:])]), 2, 4000)
    agree = s[0] == s[1]
    assert abs(agree[::2].mean() - 1 / 3) < 0.03 and abs(agree[1::2].mean() - 1 / 3) < 0.03


def test_shingles_like_plain_python():
    texts = ["A b c d", "", None, "a", "x y", "Mixed\tCASE mixed case mixed CASE", "ÀÉ àé ÀÉ b", "w " * 3000]
    for limit in (1, 1 << 20):
        for at, data, offsets in W.chunks(pa.array(texts), limit):
            w = W.words(data, offsets, W.IN_SPACED_WORD)
            text, value = W.shingles(w, 3)
            for k in range(w.n_texts):
                assert (text == k).sum() == len(shingles(texts[at + k], 3))


def test_components(spark):
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b and not any(a in p for p in links if p[0] != p[1])}
    assert got == {x: find(x) for x in root if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
