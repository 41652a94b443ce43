from collections import Counter

from pyspark.sql import functions as F

from tablelab.llm import boilerplate
from tablelab.llm.boilerplate import drop_site_lines, host_of, text_of


def expected(rows, ratio, least):
    norm = lambda x: " ".join(x.split())
    pages = Counter(s for _, _, s in rows)
    holds = Counter((s, x) for _, t, s in rows for x in {norm(y) for y in (t or "").split("\n")} if x)
    out = []
    for key, text, site in rows:
        lines = [] if text is None else text.split("\n")
        gone = [x for x in lines if norm(x) and holds[site, norm(x)] > pages[site] * ratio and holds[site, norm(x)] >= least]
        left = [x for x in lines if x not in gone]
        out.append((key, None if text is None else "\n".join(left), site, sum(1 for x in lines if norm(x)), len(lines) - len(left)))
    return sorted(out, key=repr)


def got(docs, **more):
    out = drop_site_lines(docs, F.col("source"), "text", **more)
    return sorted(((r.doc_id, r.text, r.site, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)


ROWS = [(i, f"menu\n own line {i}\n\n  Foot  er \nmenu" if i % 3 else f"own {i}\nfoot er\nFoot er", "hot") for i in range(40)]
ROWS += [(100 + i, f"menu\nline {i}", f"site{i % 4}") for i in range(8)]
ROWS += [(200, None, "hot"), (201, "", "hot"), (202, "menu", None), (203, "menu\nrest", None), (204, "menu", None), (None, "menu", "hot"), (1, "menu", "hot"), (1, "menu", "hot"),
         (300, "menu\n" + "very long line " * 20_000, "hot"), (301, "\n" * 5000, "hot")]


def test_against_brute_force(documents, monkeypatch):
    docs = documents(ROWS, "source")
    for broadcast in (200_000, 0):
        monkeypatch.setattr(boilerplate, "BROADCAST_ROWS", broadcast)
        for ratio, least in ((0.1, 3), (0.5, 1), (0.9, 2), (0.0, 1)):
            assert got(docs, ratio=ratio, least=least) == expected(ROWS, ratio, least)


def test_empty_and_clashing(documents):
    assert got(documents([], "source")) == []
    docs = documents([(i, f"same\n{i}", "s", "a", "b") for i in range(4)], "source", "site", "row")
    out = drop_site_lines(docs, F.col("source"), "text").orderBy("doc_id").collect()
    assert [(r.text, r.site, r.row, r.n_dropped) for r in out] == [(str(i), "s", "b", 1) for i in range(4)]


def test_hosts_and_texts(spark):
    urls = [("http://User@A.example.COM:80/x?y", "a.example.com"), ("https://b.org", "b.org"), ("nothing", ""), (None, ""), ("ftp://c/d", "c")]
    df = spark.createDataFrame(urls, "url string, want string").select(host_of(F.col("url")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    html = "<html><script>var x = '<p>';</script><p>One<br>two</p><!-- no\n --><STYLE>p{}</STYLE>three</html>"
    text = spark.createDataFrame([(html,), (None,)], "html string").select(text_of(F.col("html")).alias("t")).collect()
    assert [x for x in text[0].t.split("\n") if x.strip()] == ["One", "two", "three"] and text[1].t == ""
