import itertools

import numpy as np
import pytest

from loomline.llm import graph, jaccard
from tests.llm.support import DOC_SCHEMA, EDGES, edge_docs, empty_docs


def sets_of(text, width=5):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
    n = min(width, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, width=5, percent=75):
    ids = [r[0] for r in rows]
    sets = [sets_of(r[1], width) for r in rows]
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets), 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in zip(ids, sets)), key=str)


def got_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def edited(rng, words, changes):
    words = list(words)
    for at in rng.integers(0, len(words), changes):
        words[at] = f"x{rng.integers(1e6)}"
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    """Families of edited copies around the threshold, a passage that many texts share, and chains."""
    rng = np.random.default_rng(seed)
    rows, passage = [], " ".join(f"p{i}" for i in range(30))
    for family in range(8):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(20, 120)))]
        for _ in range(12):
            base = edited(rng, base, int(rng.integers(0, 3)))  # a drift: ends of the chain are far apart
            rows.append((len(rows), " ".join(base)))
    for k in range(60):
        rows.append((len(rows), passage + " " + " ".join(f"q{k}_{j}" for j in range(int(rng.integers(0, 14))))))
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t, "", "", 0) for i, t in rows]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(7)
    assert got_of(jaccard.jaccard_components(docs)) == brute(rows)


def test_links_that_no_group_of_hashes_finds(spark, monkeypatch):
    """The product alone finds every link."""
    monkeypatch.setattr(jaccard, "_SALTS", jaccard._SALTS[:0])
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, i % 4)), "", "", 0) for i in range(25)]
    from loomline.llm import packed  # noqa: F401

    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    assert got_of(jaccard.jaccard_components(docs)) == brute(rows)


def test_edges(spark):
    assert got_of(jaccard.jaccard_components(edge_docs(spark))) == brute(EDGES)
    assert jaccard.jaccard_components(empty_docs(spark)).count() == 0


def test_one_id_with_two_texts_is_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(5, a, "", "", 0), (5, b, "", "", 0), (7, a, "", "", 0), (2, b + " tail", "", "", 0), (9, "else", "", "", 0)]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert got == {(5, 2), (7, 2), (2, 2), (9, 9)}


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 99)] + [(200, 200 + i) for i in range(1, 40)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == got[100] == got[99] == 99 and {got[i] for i in range(200, 240)} == {200}
