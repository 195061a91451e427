import itertools

import numpy as np
import pytest

from loomline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, top=20):
    known = {}
    for i, v, *_ in rows:
        if i is not None and v and not any(x is None or not np.isfinite(x) for x in v) and any(v):
            known[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(known))
    out = {}
    if not len(ids):
        return out
    e = np.stack([known[i] for i in ids])
    for q in ids[ids % every == 0]:
        score = ann.exact_products(known[q][None], e)[0]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:top]
        out[int(q)] = [(int(ids[k]), float(score[k])) for k in order]
    return out


def got_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_all_cells_give_the_exact_answer(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(7).round(1).tolist(), 0) for i in range(400)]
    rows += [(1000 + i, [1.0] * 7, 0) for i in range(90)]  # a vector with very many copies, queries among them
    got = got_of(ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(6), recall=1.0))
    assert got == brute(rows)


def seeded_table(spark, n=9000, d=24):
    """Vectors around seeded centres, more of them than the given folders hold."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, d))[rng.integers(0, 60, n)] + 0.7 * rng.standard_normal((n, d))
    return spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))], SCHEMA).repartition(8)


@pytest.mark.parametrize("block", [7, 60, 1000])
def test_blocks_of_any_size_give_the_exact_answer(spark, monkeypatch, block):
    """Cells packed together, alone, or split over several tasks; queries in several parts."""
    monkeypatch.setattr(ann, "ENTRY_BLOCK", block)
    monkeypatch.setattr(ann, "BLOCK", 5)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist(), 0) for i in range(500)]  # many ties
    assert got_of(ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), recall=1.0)) == brute(rows)


def test_cells_are_packed_in_order():
    assert ann.cell_blocks(np.array([3, 0, 4, 9, 1, 1, 20, 2]), 8).tolist() == [0, 0, 0, 1, 2, 2, 3, 4]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1", "seeded"])
def test_recall(spark, sf):
    table = seeded_table(spark) if sf == "seeded" else spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = got_of(ann.nearest(table))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    assert hits / (20 * len(want)) >= 0.9


def test_edges(spark):
    rows = [(0, [1.0, 0.0, 2.0], 1), (20, None, 1), (40, [0.0, 0.0, 0.0], 1), (60, [1.0, float("nan"), 0.0], 1), (80, [1.0, None, 0.0], 1), (100, [float("inf"), 0.0, 0.0], 1), (120, [1.0, 2.0], 1), (140, [], 1),
            (None, [1.0, 1.0, 1.0], 1), (7, [1.0, 0.0, 2.0], None), (7, [1.0, 0.0, 2.0], None), (9, [-1.0, 0.0, 0.5], 1), (160, [2.0, 0.0, 0.0], 1)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("v", "cell", "rank", "score", "place", "rep")})
    got = got_of(ann.nearest(df))
    assert got == {0: [(7, 5.0), (160, 2.0), (9, 0.0)], 160: [(0, 2.0), (7, 2.0), (9, -2.0)]}
    assert ann.nearest(df.where("false")).count() == 0
    assert ann.nearest(df.where("vec_id = 40")).count() == 0


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    counts = rng.integers(0, 4, 30)
    order = sorted(itertools.product(range(6), range(5)), key=lambda p: a[p[0]] + b[p[1]])
    want = [i * 5 + j for i, j in order if counts[i * 5 + j]]
    assert ann.cells_by_distance(a, b, counts, np.inf) == want
    few = ann.cells_by_distance(a, b, counts, 10)
    assert few == want[:len(few)] and counts[few].sum() >= 10 > counts[few[:-1]].sum()
