import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loomline.llm import lm
from tests.llm.support import DOC_SCHEMA, EDGES, edge_docs, empty_docs


def brute(rows, order, mass, share=lm.SHARE):
    """Counts in dictionaries and one recursive probability per token."""
    texts = []
    for i, t, *_ in rows:
        words = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        texts.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, [w for w in words.split(" ") if w] + ["<end>"]))
    grams = Counter()
    for _, held, toks in texts:
        if not held:
            for k in range(1, order + 1):
                grams.update(tuple(toks[i:i + k]) for i in range(len(toks) - k + 1))
    n = sum(c for g, c in grams.items() if len(g) == 1)
    v = sum(1 for g in grams if len(g) == 1)

    def p(history, w):
        if not history:
            return (grams[(w,)] + 0.5) / (n + 0.5 * (v + 1))
        h = grams[history]
        lower = p(history[1:], w)
        m = mass + share * h
        return (grams[(*history, w)] + m * lower) / (h + m) if h else lower

    out = []
    for i, held, toks in texts:
        score = base = 0.0
        fails = 0
        for t, w in enumerate(toks):
            history = tuple(toks[max(0, t - order + 1):t])
            score += math.log10(p(history, w))
            base += math.log10(p((), w))
            while history and not (grams[history] and grams[(*history, w)]):
                fails += bool(grams[history])
                history = history[1:]
        out.append((i, held, len(toks), sum(1 for w in toks if grams[(w,)]), n, base, score, fails))
    return out


def close(got, want):
    key = lambda r: str(r[0]) + str(r[2])
    got = sorted((tuple(r) for r in got.collect()), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[7] == w[7] and np.allclose(g[5:7], w[5:7], rtol=1e-9), (g, w)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_recursion(spark, order):
    rng = np.random.default_rng(order)
    rows = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.5, int(rng.integers(0, 40))) % 50), "", "", 0) for i in range(120)]
    close(lm.score_texts(spark.createDataFrame(rows, DOC_SCHEMA).repartition(4), order=order, mass=3.0, batch_words=200), brute(rows, order, 3.0))


def test_edges(spark):
    close(lm.score_texts(edge_docs(spark)), brute(EDGES, lm.ORDER, lm.MASS))
    assert lm.score_texts(empty_docs(spark)).count() == 0
    alone = lm.score_texts(spark.createDataFrame([(k, "a b", "", "", 0) for k in range(30) if zlib.crc32(str(k).encode()) % 5 == 1], DOC_SCHEMA)).collect()
    assert alone and all(r["held_out"] and r["n_known"] == 0 and r["score"] == 0.0 for r in alone)


def test_probabilities_sum_to_one(spark):
    """Scores of every continuation of one history, known words and one unknown, add up to the history's own."""
    rows = [(i, t, "", "", 0) for i, t in enumerate(["a b c", "a c", "b b a", "c a b a", "a a", "b"]) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [k for k in range(100, 400) if zlib.crc32(str(k).encode()) % 5 == 1]
    rows += [(held[j], f"a {w}", "", "", 0) for j, w in enumerate(["a", "b", "c", "zz"])]
    got = {r["doc_id"]: 10 ** r["score"] for r in lm.score_texts(spark.createDataFrame(rows, DOC_SCHEMA), mass=2.0).collect()}
    want = {r[0]: 10 ** r[6] for r in brute(rows, 2, 2.0)}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_model_beats_base_on_held_out_text(spark):
    """Text with an order of words: the automaton knows it, single words do not."""
    rng = np.random.default_rng(8)
    step = {i: rng.choice(30, 3) for i in range(30)}
    rows = []
    for i in range(300):
        w, out = int(rng.integers(30)), []
        for _ in range(40):
            out.append(f"w{w}")
            w = int(rng.choice(step[w]))
        rows.append((i, " ".join(out), "", "", 0))
    held = lm.score_texts(spark.createDataFrame(rows, DOC_SCHEMA), mass=5.0, share=0.0).where("held_out")
    r = held.selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > 0.5 * r["b"]
