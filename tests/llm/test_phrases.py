import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomline.llm import phrases
from tests.llm.support import DOC_SCHEMA, EDGES, edge_docs, empty_docs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, most_words=3, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (r[1] or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        long = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in long.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i:i + k]] = max(around[p[i:i + k]], a)
        rows = []
        for p, a in long.items():
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            if 2 * around[p] < a or p not in around:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]  # noqa: E741
    return sorted(out)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts)


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
@pytest.mark.parametrize("most_words", [2, 3, 4])
def test_against_counting(spark, shard_bytes, most_words):
    rng = np.random.default_rng(3)
    vocabulary = ["Red", "red", "fox", "é", "a-b", "ran", "\x00x", "日本"]
    rows = [(i, "".join(vocabulary[k] + [" ", "\t ", ". ", "\n", ","][min(4, int(rng.exponential(0.7)))] for k in rng.zipf(1.4, rng.integers(0, 40)) % 8), ["en", "de", None, ""][i % 4 if i % 3 else 0], "s", 1) for i in range(200)]
    got = phrases.collocations(table(spark, rows), most_words, 5, 40, shard_bytes).collect()
    assert sorted(map(tuple, got)) == brute(rows, most_words, 5, 40)


def test_intervals_hold_every_phrase():
    rng = np.random.default_rng(8)
    x = np.concatenate(([0], rng.integers(0, 5, 400), [0])).astype(np.int32)
    for k, (words, size) in enumerate(phrases.phrases_of(x, 5), 1):
        want = Counter(tuple(x[i:i + k]) for i in range(len(x) - k + 1) if (x[i:i + k] > 0).all())
        assert {tuple(w): c for w, c in zip(words.tolist(), size.tolist())} == want


def test_ends_of_pieces_and_cases(spark):
    rows = [(1, "New York. York new, NEW YORK! new york", "en", "", 1)] * 10
    got = [tuple(r) for r in phrases.collocations(table(spark, rows)).collect()]
    assert got == brute(rows) and [(r[2], r[3], r[4], r[5]) for r in got] == [("new york", 20, 30, 30), ("york new", 10, 30, 30)]


def test_part_of_a_longer_phrase_goes(spark):
    rows = [(i, "by and large" + (" . by and" if i < 9 else ""), "en", "", 1) for i in range(10)] + [(i, "and large", "en", "", 1) for i in range(11)]
    got = [r["phrase"] for r in phrases.collocations(table(spark, rows)).collect()]
    assert got == [r[2] for r in brute(rows)] and "by and" not in got and "and large" in got and "by and large" in got


def test_false_survivors_do_not_count(spark, monkeypatch):
    """With hashes of a few bits nearly everything is sent in words; the counts stay exact."""
    monkeypatch.setattr(phrases, "SPARE_BITS", -100)
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(30)), "en", "", 1) for i in range(40)]
    assert sorted(map(tuple, phrases.collocations(table(spark, rows)).collect())) == brute(rows)


def test_edges(spark):
    got = phrases.collocations(edge_docs(spark).union(edge_docs(spark)), least=2).collect()
    assert sorted(map(tuple, got)) == brute(EDGES * 2, least=2)
    assert phrases.collocations(empty_docs(spark)).count() == 0
