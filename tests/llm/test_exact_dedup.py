from collections import defaultdict

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelab.llm.exact_dedup import exact_dedup, merge_counters


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=40), max_size=6), st.integers(1, 5))
def test_counters_keep_their_bound(batches, limit):
    counters = pd.Series(dtype="int64")
    for batch in batches:
        counters = merge_counters(counters, pd.Series(batch, dtype="int64").value_counts(sort=False), limit)
    everything = [x for batch in batches for x in batch]
    assert len(counters) <= limit
    for x in set(everything):
        true = everything.count(x)
        assert true - len(everything) / (limit + 1) <= counters.get(x, 0) <= true


def expected(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    out = []
    for key, text in rows:
        own = groups[text or ""]
        keys = [k for k in own if k is not None]
        out.append((key, max(keys) if keys else None, len(own)))
    return out


def check(got, rows):
    assert sorted(map(repr, [(r.doc_id, r.keep_id, r.group_size) for r in got])) == sorted(map(repr, expected(rows)))
    stays = defaultdict(list)
    for r in got:
        if r.kept:
            assert r.doc_id == r.keep_id
            stays[r.text_sha256].append(r.doc_id)
    assert all(len(v) == 1 for v in stays.values()) and set(stays) == {r.text_sha256 for r in got}


def test_hot_groups_nulls_and_ties(documents):
    rows = [(i, "hot") for i in range(60)] + [(100 + i, f"text {i % 25}") for i in range(50)]
    rows += [(5, "hot"), (None, "hot"), (None, "alone"), (None, "alone"), (200, None), (201, ""), (7, "long " * 30_000), (8, "long " * 30_000)]
    for share, counters in ((1024, 4096), (4, 8), (2, 2)):  # nothing, some and hardly anything is split off
        check(exact_dedup(documents(rows), share=share, counters=counters).collect(), rows)


def test_extra_columns_and_empty(documents):
    docs = documents([(1, "a", "x", "y"), (2, "a", "x", "y")], "digest", "kept")
    assert sorted((r.doc_id, r.kept) for r in exact_dedup(docs).collect()) == [(1, False), (2, True)]
    assert exact_dedup(documents([])).collect() == []
