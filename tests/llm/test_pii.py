import random
import re

import numpy as np
import pytest

from tablelab.llm import pii

PATTERNS = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, kind != 1 or all(int(x) <= 255 for x in m.group().split(".")), 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15][kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_like_the_patterns():
    draw = random.Random(1)
    pieces = ["a@b.c", "@", "x@y", "x@y.z.w@q.r", "..a%@-.-", "1.2.3.4", "255.256.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.09", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "12 34",
              "+1 (449) 555-7462", "+12", "++1234567", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", " ", "é", "\n", ".", "-", "Z9"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(1, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_long_words_cost_no_more():
    for text in ("a" * 400_000, "a" * 200_000 + "@" + "b" * 200_000, "1" * 300_000, "1." * 100_000, "+" * 200_000, "@" * 200_000, "9 " * 200_000):
        assert len(pii.base_spans(text)) >= 0


def test_gradients():
    draw = np.random.default_rng(0)
    m = pii.Tagger.fresh()
    x, y = draw.integers(0, pii.N_CHARS, (3, 6)), draw.integers(0, pii.N_TAGS, (3, 6))
    _, grads = pii.gradients(m, x, y)
    for k, (p, g) in enumerate(zip(m.parameters(), grads)):
        at = (x[0, 0], 3) if k == 0 else tuple(int(draw.integers(0, s)) for s in p.shape)
        kept, ends = p[at], []
        for step in (1e-5, -1e-5):
            p[at] = kept + step
            ends.append(pii.gradients(m, x, y)[0])
        p[at] = kept
        assert abs((ends[0] - ends[1]) / 2e-5 - g[at]) < 1e-5


def test_viterbi_against_all_paths():
    import itertools

    draw = np.random.default_rng(2)
    m = pii.Tagger.fresh()
    m.trans[:], m.first[:], m.last[:] = draw.normal(size=m.trans.shape), draw.normal(size=m.first.shape), draw.normal(size=m.last.shape)
    e = draw.normal(size=(3, 2, pii.N_TAGS))
    best = pii.viterbi(m, e)
    z, _, _ = pii.crf_marginals(m, e)
    for w in range(2):
        score = {p: m.first[p[0]] + m.last[p[-1]] + sum(e[t, w, p[t]] for t in range(3)) + m.trans[p[0], p[1]] + m.trans[p[1], p[2]] for p in itertools.product(range(pii.N_TAGS), repeat=3)}
        assert tuple(best[w]) == max(score, key=score.get)
        assert abs(np.log(sum(np.exp(v) for v in score.values())) - z[w]) < 1e-9


def test_windows_cover_every_hint():
    draw = random.Random(3)
    for n in (1, 5, 95, 96, 97, 500):
        text = "".join(draw.choice("ab 1@" if draw.random() < 0.05 else "ab ") for _ in range(n))
        starts, x = pii.windows(pii.codes(text))
        for i, c in enumerate(text):
            if c in "1@":
                covering = [s for s in range(0, n, pii.STRIDE) if s <= i < s + pii.WIDTH]
                assert set(covering) <= set(starts.tolist())
        assert x.shape == (len(starts), pii.WIDTH)


def test_reconcile_is_the_best_set():
    import itertools

    draw = random.Random(4)
    for _ in range(200):
        found = [(draw.randrange(4), s := draw.randrange(20), s + draw.randrange(1, 6), draw.random()) for _ in range(draw.randrange(0, 7))]
        best = 0.0
        for r in range(len(found) + 1):
            for pick in itertools.combinations(found, r):
                if all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(pick, 2)):
                    best = max(best, sum(p * (e - s) for _, s, e, p in pick))
        chosen = pii.reconcile(found)
        top = {}
        for k, s, e, p in found:
            top[k, s, e] = max(top.get((k, s, e), 0), p)
        assert abs(sum(top[c] * (c[2] - c[1]) for c in chosen) - best) < 1e-9


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9)))
    item = [lambda: f"{word()}.{draw.randrange(99)}@{word()}.com", lambda: ".".join(str(draw.randrange(256)) for _ in range(4)),
            lambda: f"+{draw.randrange(1, 99)} ({draw.randrange(100, 999)}) 555-{draw.randrange(1000, 9999)}", lambda: f"version {draw.randrange(9)}.{draw.randrange(9)}"]
    return [" ".join([*(word() for _ in range(draw.randrange(30))), draw.choice(item)(), *(word() for _ in range(draw.randrange(30)))]) for _ in range(500)]


def test_trained_tagger_on_held_out_texts(documents, texts):
    model = pii.fit_pii(documents(list(enumerate(texts[:350]))))
    base = [pii.base_spans(t) for t in texts[350:]]
    found = pii.model_spans(model, texts[350:], [[] for _ in base])
    want, got = {(i, s) for i, own in enumerate(base) for s in own}, {(i, s) for i, own in enumerate(found) for s in own}
    assert len(want & got) / len(want) > 0.9 and len(want & got) / max(len(got), 1) > 0.9
    rows = pii.find_pii(documents(list(enumerate(texts[350:])) + [(900, None), (901, ""), (901, ""), (None, "x" * 200_000 + " a@b.cd")], ), model, ["doc_id"]).collect()
    assert len(rows) == 154
    for r in rows:
        spans = [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.base]
        if r.doc_id is not None and r.doc_id < 900:
            assert spans == pii.base_spans(texts[350 + r.doc_id])
        assert all(a.end <= b.start or a.start >= b.end for a in r.added for b in r.base)
    assert {r.doc_id: len(r.base) for r in rows}[None] == 1


def test_empty_and_clashing(documents):
    assert pii.fit_pii(documents([])) is None and pii.fit_pii(documents([(1, "no digits")])) is None
    out = pii.find_pii(documents([(1, "a@b.cd", "x")], "base"), None, ["doc_id", "base"])
    assert out.columns == ["doc_id", "base", "base", "added"] and out.count() == 1
    assert pii.find_pii(documents([]), None, ["doc_id"]).count() == 0
