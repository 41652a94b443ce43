import datetime as dt
import random

import pytest

from tablelab.llm.url_lists import active_entries, intervals

DAY = dt.date(2024, 1, 1)


def covering(url):
    if not url or "://" not in url:
        return set()
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, _, path = rest.partition("/")
    host = host.split("@")[-1].split(":")[0].lower()
    if not host:
        return set()
    labels, parts = host.split("."), [p for p in path.split("/") if p]
    return {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(parts[:i]) for i in range(1, len(parts) + 1)}


def expected(captures, history):
    out = []
    for key, url, at in captures:
        active = []
        for name in covering(url):
            past = [(a, on) for n, a, on in history if n == name and a is not None and on is not None and at is not None and a <= at]
            if past and max(past)[1]:
                active.append(name)
        out.append((key, bool(active), len(active), min(active, key=lambda n: (-len(n), n)) if active else None))
    return sorted(out, key=repr)


@pytest.fixture
def tables(spark):
    return lambda captures, history: (spark.createDataFrame(captures, "page_id long, url string, at date"), spark.createDataFrame(history, "name string, at date, listed boolean"))


def test_against_brute_force(tables):
    draw = random.Random(1)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.org"]
    urls = [f"https://{'U@' if draw.random() < 0.2 else ''}{draw.choice(hosts)}{draw.choice(['', ':80'])}{draw.choice(['', '/', '/p', '/p/q', '//p/', '/P?x=/z', '#f'])}" for _ in range(150)] + [None, "", "nothing", "http:///p"]
    captures = [(i, u, DAY + dt.timedelta(days=draw.randrange(200))) for i, u in enumerate(urls * 2)] + [(1, "http://x.org", None), (None, "http://x.org", DAY), (5, "http://x.org", DAY), (5, "http://x.org", DAY)]
    names = [*hosts, "com", "org", "a.example.com/p", "a.example.com/p/q", "x.org/P"]
    history = [(draw.choice(names), DAY + dt.timedelta(days=draw.randrange(-40, 250)), draw.random() < 0.6) for _ in range(300)] + [(None, DAY, True), ("x.org", None, True), ("x.org", DAY, None)]
    out = active_entries(*tables(captures, history)).collect()
    assert sorted(((r.page_id, r.blocked, r.n_active, r.entry) for r in out), key=repr) == expected(captures, history)


def test_intervals(tables):
    history = [("a", DAY, True), ("a", DAY, False), ("a", DAY + dt.timedelta(days=100), True), ("a", DAY + dt.timedelta(days=101), False), ("b", DAY, False)]
    got = sorted((r.name, r.since, r.until) for r in intervals(tables([(1, "x", DAY)], history)[1]).collect())
    assert got == [("a", DAY, DAY + dt.timedelta(days=100)), ("a", DAY + dt.timedelta(days=100), DAY + dt.timedelta(days=101))]


def test_empty_and_clashing(tables, spark):
    captures, history = tables([(1, "http://a.b", DAY)], [])
    assert [r.blocked for r in active_entries(captures, history).collect()] == [False]
    assert active_entries(captures.limit(0), history).collect() == []
    clash = spark.createDataFrame([(1, "http://a.b", DAY, "e", "n")], "page_id long, url string, at date, entry string, name string")
    out = active_entries(clash, spark.createDataFrame([("b", DAY, True)], "name string, at date, listed boolean")).first()
    assert (out.entry, out.name, out.blocked) == ("b", "n", True)


def test_far_dates_write_no_month_without_captures(tables, monkeypatch):
    """Open intervals, and captures and entries thousands of years apart: rows follow intervals and months of captures."""
    far = dt.date(9999, 12, 31)
    history = [(f"h{i}.org", DAY, True) for i in range(200)] + [("h0.org", far, False), ("h1.org", dt.date(1, 1, 1), True)]
    captures = [(i, f"http://h{i % 3}.org/p", DAY + dt.timedelta(days=i)) for i in range(60)] + [(60, "http://h0.org", far), (61, "http://h5.org", far)]
    written = []
    monkeypatch.setattr("tablelab.llm.url_lists.checkpointed", lambda df: written.append(df) or df)
    out = active_entries(*tables(captures, history)).collect()
    assert sorted(((r.page_id, r.blocked, r.n_active, r.entry) for r in out), key=repr) == expected(captures, history)
    assert max(df.count() for df in written) <= 205


def test_one_name_with_a_long_history(tables):
    """Entries of one name on and off every day, all captures under it."""
    history = [("x.org", DAY + dt.timedelta(days=i), i % 2 == 0) for i in range(800)]
    captures = [(i, "http://x.org/p/q", DAY + dt.timedelta(days=(i * 37) % 1000)) for i in range(300)]
    out = active_entries(*tables(captures, history)).collect()
    assert sorted(((r.page_id, r.blocked, r.n_active, r.entry) for r in out), key=repr) == expected(captures, history)
