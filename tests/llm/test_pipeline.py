"""The pipeline on a small corpus with known cases, stage by stage."""

import random

import pytest

import corpus_pipeline as P
from tests.llm.test_decontamination import expected as contaminated
from tests.llm.test_minmax import expected as clusters

STAGES = dict(P.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(9)
    prose = lambda n, w="w": " ".join(" ".join(f"{w}{draw.randrange(3000)}" for _ in range(9)) + "." for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        text = prose(6, "wv"[i % 3 == 0])
        bad = i % 5 == 0
        if bad:
            text = text.replace(". ", f" {draw.choice(['rotter', 'badness'])} . ", 1)
        rows.append((i, text, "vw"[i % 3 != 0], f"src{i % 3}", len(text)))
        if i < 200:
            labels.append((i, int(i % 7 != 0), int(bad)))
    item = prose(2, "bench")
    rows += [(400, rows[1][1] + "\nMenu line here", "w", "src1", 0), (401, rows[2][1].replace("w", "w", 1), "w", "src1", 0), (402, prose(3) + " " + item, "w", "src2", 0),
             (403, None, None, None, None), (404, "", "w", "src0", 0), (None, prose(3), "w", "src0", 0), (405, prose(2), "w", "src0", 5), (405, prose(2), "w", "src0", 5)]
    rows = [(k, t if t is None or s != "src1" else t + "\nMenu line here", a, s, n) for k, t, a, s, n in rows]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, item


def test_stages(spark, corpus):
    folder, rows, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: repr(r[0]) + repr(r[1])
    plain = lambda df: sorted(map(tuple, df.collect()), key=key)

    calm = STAGES["toxicity"](spark, docs, folder)
    kept = {r[0] for r in plain(calm)}
    toxic = {i for i in range(300) if i % 5 == 0}
    assert len(toxic & kept) <= 2 and len([i for i in range(300) if i not in toxic and i not in kept]) <= 2 and calm.columns == docs.columns

    lined = STAGES["line_dedup"](spark, calm, folder)
    assert lined.columns == docs.columns and lined.count() == calm.count()
    assert not [r for r in plain(lined) if r[1] and "Menu line here" in r[1]]
    assert all(r[1] is None or r[3] != "src1" or r[4] == len(r[1]) for r in plain(lined))

    near = STAGES["near_dedup"](spark, lined, folder)
    before = plain(lined)
    stay = {c[0] for c in clusters([(r[0], r[1]) for r in before], 5, 80) if c[3]}
    assert plain(near) == [r for r in before if r[0] in stay]

    clean = STAGES["decontamination"](spark, near, folder)
    bad = {c[0] for c in contaminated([(r[0], r[1]) for r in plain(near)], [(1, item)]) if c[5]}
    assert bad and plain(clean) == [r for r in plain(near) if r[0] not in bad]

    mixed = STAGES["mixing"](spark, clean, folder)
    assert mixed.columns == [*docs.columns, "rate", "copies", "domain"]
    assert {r[:5] for r in plain(mixed)} <= set(plain(clean)) and all(r[6] >= 1 and r[5] > 0 for r in plain(mixed))


def test_run_is_the_stages_in_order(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(repr, docs.collect())) == sorted(map(repr, P.run(spark, folder).collect()))


def test_clashing_columns_and_empty_tables(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES:
        clash = docs.selectExpr("*", "'a' AS site", "'b' AS score", "'c' AS row", "'d' AS id", "'e' AS best", "'f' AS n_dropped")
        out = stage(spark, clash, folder)
        assert out.columns[: len(clash.columns)] == clash.columns and out.first()["site"] == "a" and out.count() > 100, name
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_lines_of_large_sources_go_and_copied_texts_stay(spark):
    rows = [(i, f"own line {i}\n" + "shared line" * (i < 25) + "\nfew" * (i < 4), "en", "large", 0) for i in range(1700)]
    rows += [(2000 + i, "copied text\nwith two lines", "en", "large", 0) for i in range(60)] + [(3000 + i, f"other {i}\nshared line", "en", "small", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in STAGES["line_dedup"](spark, docs, "").collect()}
    assert len(got) == len(rows)
    assert all("shared line" not in got[i] and f"own line {i}" in got[i] for i in range(1700))  # 1.4 % of the source
    assert all("few" in got[i] for i in range(4)) and all(got[2000 + i] == "copied text\nwith two lines" for i in range(60))
    assert all("shared line" in got[3000 + i] for i in range(4))
