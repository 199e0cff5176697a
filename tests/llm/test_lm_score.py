import math
from collections import Counter

import pytest

from docverify.llm import lm_score


def brute(rows, targets, order):
    """The same models counted in dictionaries."""
    vocabulary = {c for _, t in rows for c in t or ""}

    def grams(text):
        padded = ["^"] * (order - 1) + list(text or "")
        return [tuple(padded[i : i + order]) for i in range(len(text or ""))]

    def model(texts):
        c = [Counter(g[-k:] for t in texts for g in grams(t)) for k in range(1, order + 1)]
        total = sum(c[0].values())

        def p(g):
            if len(g) == 1:
                return (c[0][g] + 1) / (total + len(vocabulary) + 2)
            follow = {x: n for x, n in c[len(g) - 1].items() if x[:-1] == g[:-1]}
            lower = p(g[1:])
            return lower if not follow else (follow.get(g, 0) + len(follow) * lower) / (sum(follow.values()) + len(follow))

        return p

    t, b = model([x for i, x in rows if i in targets]), model([x for _, x in rows])
    out = []
    for i, x in rows:
        g = grams(x)
        if g:
            lt, lb = (sum(-math.log(m(y)) for y in g) / len(g) for m in (t, b))
            out.append((i, len(g), lt, lb, lt - lb))
        else:
            out.append((i, 0, None, None, None))
    return out


def test_against_brute_force(spark):
    rows = [(1, "abab abc"), (2, "zzz"), (3, None), (4, ""), (5, "é漢🙂 ab"), (None, "abab"), (2, "zzz"), (7, "the cat " * 40)]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, gram string")
    good = spark.createDataFrame([(1,), (1,), (5,), (99,), (None,)], "doc_id long")
    got = [tuple(r) for r in lm_score.score(docs, good, order=3, block_chars=40).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(got, key=key), sorted(brute(rows, {1, 5}, 3), key=key), strict=True):
        assert g[:2] == w[:2]
        assert (g[2] is None) == (w[2] is None)
        if w[2] is not None:
            assert g[2:] == pytest.approx(w[2:], abs=1e-9)


def test_one_id_with_most_of_the_text(spark):
    """Its rows are dealt over many blocks, as a target too; so are those without an id."""
    texts = [f"{w} {k} {w[::-1]}" for k in range(25) for w in ("alpha", "beta")]
    rows = [(7, t) for t in texts] + [(None, t) for t in texts[:20]] + [(i, t) for i, t in enumerate(texts[:6], 100)] + [(8, "x" * 300), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(7,), (101,), (None,)], "doc_id long")
    got = [tuple(r) for r in lm_score.score(docs, good, order=3, block_chars=30).collect()]
    want = brute(rows, {7, 101}, 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None)
        if w[2] is not None:
            assert g[2:] == pytest.approx(w[2:], abs=1e-9)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(docs, docs).count() == 0
