import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import periods
from tests.llm.support import DOC_SCHEMA, EDGES, edge_docs, empty_docs


def brute(x):
    """Every lag over the whole text."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=30), st.integers(1, 7), st.integers(0, 9)), max_size=6))
def test_all_runs_are_found(parts):
    x = []
    for word, times, more in parts:
        x += word * times + word[:more]
    assert periods.find_runs(np.array(x, np.int64)) == brute(x)


def test_long_periods_and_fractions():
    rng = np.random.default_rng(5)
    for q in (1, 2, 4, 5, 8, 9, 16, 17, 33, 64, 100, 257):
        for n in (4 * q - 1, 4 * q, 4 * q + 1, 7 * q + q // 2):
            body = rng.integers(0, 50, q)
            x = np.concatenate((rng.integers(100, 10**6, 37), np.resize(body, n), rng.integers(100, 10**6, 21)))
            assert periods.find_runs(x) == brute(x.tolist())


def test_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    t = [bin(i).count("1") % 2 for i in range(1024)]
    for x in (b, t, b + t, t[:300] * 5):
        assert periods.find_runs(np.array(x)) == brute(x)


def digest(rows):
    out = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words) if len(words) < 3000 else periods.find_runs(np.unique(np.array(words, object), return_inverse=True)[1])
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        out.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(out, key=str)


def test_rows_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, " \t".join(["ab", "cd", "é", "x"][k] for k in np.resize(rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 60))), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    got = periods.run_digests(periods.periodic_runs(docs, periods.wrapped_tail)).collect()
    assert sorted((tuple(r) for r in got), key=str) == digest(rows)


def test_edges(spark):
    got = periods.run_digests(periods.periodic_runs(edge_docs(spark), periods.wrapped_tail)).collect()
    assert sorted((tuple(r) for r in got), key=str) == digest(EDGES)
    assert periods.periodic_runs(empty_docs(spark)).count() == 0


def test_collapsed_text_and_spans(spark):
    docs = spark.createDataFrame([(1, "say it " + "no more " * 5 + "please", "", "", 1), (2, "a b c", "", "", 1)], DOC_SCHEMA)
    got = {r["doc_id"]: r for r in periods.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(2, 10, 2)] and got[1]["collapsed"] == "say it no more please" and got[1]["strongest"]["period"] == 2
    assert got[2]["runs"] == [] and got[2]["strongest"] is None and got[2]["collapsed"] == "a b c"
