import random
import re

from pyspark.sql import functions as F

from tablelab.llm.units import remove_repeats, repeated_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ENDS = {"line": "\n", "sentence": r"[.!?\n]"}


def units(text, unit, context):
    if unit == "paragraph":
        cuts = [m.end() for m in re.finditer(r"(?<=\n)\n", text or "")]
    else:
        cuts = [m.end() for m in re.finditer(ENDS[unit], text or "")]
    every = [m.group().translate(LOWER) for m in WORD.finditer(text or "")]
    out, n = [], 0
    for s, e in zip([0, *cuts], [*cuts, len(text or "")]):
        found = list(WORD.finditer((text or "")[s:e]))
        if found:
            compared = (len(found), *every[n : n + max(len(found), context)])
            out.append((s + found[0].start(), s + found[-1].end(), len(found), compared))
            n += len(found)
    return out


def expected(rows, unit, least, context):
    """rows in rank order."""
    first, out = {}, []
    for key, text in rows:
        run = []
        for s, e, n, words in [*units(text, unit, context), (None, None, None, None)]:
            if words is not None and words in first:
                run.append((s, e, n, first[words]))
                continue
            if run and sum(r[2] for r in run) >= least:
                froms = [r[3] for r in run if r[3] is not None]
                out.append((key, run[0][0], run[-1][1], sum(r[2] for r in run), min(froms) if froms else None))
            run = []
            if words is not None:
                first[words] = key
    return sorted(out, key=repr)


def got(docs, **more):
    return sorted(((r.id, r.start, r.end, r.words, r.first_id) for r in repeated_spans(docs, **more).collect()), key=repr)


def rows_of(seed):
    draw = random.Random(seed)
    pool = [" ".join(f"w{draw.randrange(30)}" for _ in range(draw.randrange(1, 9))) for _ in range(25)]
    rows = [(i, "".join(draw.choice(pool) + draw.choice([". ", "!\n", "\n", "\n\n", "?? "]) for _ in range(draw.randrange(0, 14)))) for i in range(60)]
    return rows + [(70, None), (71, ""), (72, "...\n\n"), (73, "Über Äs. über äs. Über Äs."), (74, "tail " * 60_000), (75, "tail " * 60_000), (76, "hot line"), *[(80 + i, "hot line") for i in range(30)], (None, "hot line")]


def test_against_brute_force(documents):
    rows = rows_of(1)
    docs = documents(rows).repartition(5, "text")
    for unit in ("line", "paragraph", "sentence"):
        for least, context in ((0, 0), (6, 4), (25, 6)):
            assert got(docs, unit=unit, least_words=least, context_words=context) == expected(rows, unit, least, context), (unit, least)


def test_passage_inside_another_text(documents):
    draw = random.Random(2)
    prose = lambda n: " ".join(" ".join(f"v{draw.randrange(9999)}" for _ in range(10)).capitalize() + "." for _ in range(n))
    passage = prose(6)
    rows = [(i, prose(5)) for i in range(20)] + [(50, f"{prose(2)} cut off {passage} {prose(2)}"), (40, passage), (60, f"{prose(1)} and {passage}")]
    found = repeated_spans(documents(rows)).collect()
    assert sorted((r.id, r.first_id) for r in found) == [(50, 40), (60, 40)] and all(r.words == 50 for r in found)


def test_removal_keeps_rows_and_columns(documents):
    rows = [(1, "Menü one. Own.\nMenü one.", "a", "b"), (2, "menü ONE! Rest\nmenü one", "a", "b"), (3, None, "a", "b"), (2, "menü ONE! Rest\nmenü one", "a", "b")]
    out = remove_repeats(documents(rows, "removed", "row"), least_words=1, context_words=0).orderBy("doc_id", F.size("removed"), "text").collect()
    assert [r.text for r in out] == ["Menü one. Own.\n.", "", "! Rest\n", None] and all(r.row == "b" for r in out)
    # Of the repeated row all is repeated, of the first one only what stood before.
    assert [[(s.start, s.end, s.first_id) for s in r.removed] for r in out[1:3]] == [[(0, 23, 1)], [(0, 8, 1), (15, 23, 1)]]
    assert remove_repeats(documents([])).collect() == [] and repeated_spans(documents([])).collect() == []
