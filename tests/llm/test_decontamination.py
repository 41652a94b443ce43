import hashlib
import re

import pytest
from pyspark.sql import types as T

from tablelab.llm import decontamination
from tablelab.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(rows, items, window=10):
    out = []
    for key, text in rows:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            v = words(body)
            for run in {tuple(v[i : i + window]) for i in range(max(len(v) - window + 1, 1))} if v else ():
                for s in range(len(w) - len(run) + 1):
                    if tuple(w[s : s + len(run)]) == run:
                        hit.update(range(s, s + len(run)))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def got(docs, items, **more):
    out = decontaminate(docs, items, **more).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.fixture
def benchmark(spark):
    return lambda rows: spark.createDataFrame(rows, T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]))


ITEMS = [(1, "One two three four five six seven eight nine ten eleven TWELVE."), (2, "short item"), (10, "Short  ITEM"), (3, None), (4, "!!"), (5, "the the the the the the the the the the the"),
         (6, "déjà VU Ünder Éé 12 abc"), (None, "short item")]
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [(1, f"x {PASSAGE} y"), (2, PASSAGE.replace("six", "sex")), (3, "a short, item. And a short item"), (4, None), (5, ""), (6, "the " * 40), (7, "déjà vu Ünder Éé 12 abc déjà vu ünder Éé 12 abc"),
        (8, "one two three four five six seven eight nine ten"), (9, "two three four five six seven eight nine ten eleven twelve"), (9, PASSAGE), (None, PASSAGE), (None, "clean"),
        (11, ("filler words here " * 4000) + PASSAGE + " more" * 5000), (12, PASSAGE), (12, PASSAGE)]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_against_brute_force(documents, benchmark, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast)
    items = [(i, t) for i, t in ITEMS if i is not None]
    assert got(documents(ROWS), benchmark(items)) == expected(ROWS, items)


def test_window_sizes(documents, benchmark):
    for window in (1, 3, 12, 40):
        items = ITEMS[:3]
        assert got(documents(ROWS[:9]), benchmark(items), window=window) == expected(ROWS[:9], items, window)


def test_empty_and_clashing(documents, benchmark):
    assert got(documents([]), benchmark(ITEMS[:1])) == []
    assert got(documents(ROWS[:3]), benchmark([])) == expected(ROWS[:3], [])
    docs = documents([(1, PASSAGE, "a", "b", "c")], "row", "words", "start")
    out = decontaminate(docs, benchmark(ITEMS[:1])).collect()[0]
    assert (out.row, out.words, out.start, out.n_hit) == ("a", "b", "c", 12)
