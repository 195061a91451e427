from collections import defaultdict

import pytest

from loomline.llm import mixing
from tests.llm.support import DOC_SCHEMA, EDGES, edge_docs, empty_docs


def shares(target, nodes):
    """Water level by bisection: {name: (weight, cap)} -> {name: given}."""
    if sum(c for w, c in nodes.values() if w > 0) <= target:
        return {k: c if w > 0 else 0.0 for k, (w, c) in nodes.items()}
    low, high = 0.0, max((target + 1) / w for w, _ in nodes.values() if w > 0)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for w, c in nodes.values()) < target else (low, mid)
    return {k: min(c, w * low) for k, (w, c) in nodes.items()}


def test_budgets_against_bisection(spark):
    cfg = mixing.MixConfig(domain_weights={"d0": 5, "d1": 1}, lang_weights={"en": 3, "de": 1}, source_weights={"s0": 2, "s9": 0}, budget_share=0.8, max_epochs=2)
    rows = [(i, d, la, s, 1 + (i * 7) % 13) for i, (d, la, s) in enumerate([("d0", "en", "s0")] * 40 + [("d0", "en", "s1")] * 4 + [("d0", "de", "s2")] * 3 + [("d1", "en", "s3")] * 60 + [("d1", "en", "s9")] * 8 + [("d1", "fr", "s4")] * 1)]
    got = {tuple(r[:3]): r["quota"] for r in mixing.leaf_budgets(spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long"), cfg).collect()}
    caps = defaultdict(float)
    for _, d, la, s, n in rows:
        caps[d, la, s] += 2 * n
    total = sum(caps.values()) / 2
    spends = lambda q: cfg.lang_weights.get(q[1], 1) > 0 and cfg.source_weights.get(q[2], 1) > 0
    under = lambda *k: sum(v for q, v in caps.items() if q[:len(k)] == k and spends(q))
    want = {}
    for d, t in shares(int(0.8 * total), {d: (cfg.domain_weights.get(d, 1), under(d)) for d in {k[0] for k in caps}}).items():
        for la, u in shares(t, {q: (cfg.lang_weights.get(q, 1), under(d, q)) for q in {k[1] for k in caps if k[0] == d}}).items():
            for s, v in shares(u, {q: (cfg.source_weights.get(q, 1), caps[d, la, q]) for q in {k[2] for k in caps if k[:2] == (d, la)}}).items():
                want[d, la, s] = v
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1.001 for k in want), (got, want)


def test_shortage_goes_to_siblings_first(spark):
    """A short source's share stays in its language; the other domain gets nothing of it."""
    cfg = mixing.MixConfig(domain_weights={}, lang_weights={}, budget_share=0.5, max_epochs=1)
    rows = [(1, "d0", "en", "a", 10), (2, "d0", "en", "b", 190), (3, "d1", "en", "c", 200)]
    got = {r["source"]: r["quota"] for r in mixing.leaf_budgets(spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long"), cfg).collect()}
    assert got == {"a": 10, "b": 90, "c": 100}


def test_nothing_is_dealt_to_what_weighs_nothing(spark):
    """A language of weight 0 takes no budget with it: the other domain spends what this one cannot."""
    rows = [(i, d, la, f"{d}{la}", 500) for i, (d, la) in enumerate([("d0", "en"), ("d0", "de"), ("d1", "en"), ("d1", "de")])]
    table = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    cfg = mixing.MixConfig(domain_weights={"d0": 3, "d1": 1}, lang_weights={"de": 0}, budget_share=0.5, max_epochs=1)
    assert {r["source"]: r["quota"] for r in mixing.leaf_budgets(table, cfg).collect()} == {"d0en": 500, "d0de": 0, "d1en": 500, "d1de": 0}
    cfg = mixing.MixConfig(domain_weights={}, lang_weights={}, source_weights={"d0en": 0, "d0de": 0, "d1de": 0}, budget_share=0.25, max_epochs=1)
    assert {r["source"]: r["quota"] for r in mixing.leaf_budgets(table, cfg).collect()} == {"d0en": 0, "d0de": 0, "d1en": 500, "d1de": 0}
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.MixConfig(lang_weights={"en": bad})


def test_prefix_of_seeded_order(spark, monkeypatch):
    """Small ranges give the same choice as one range, whole epochs come first, and a seed changes the choice."""
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "en", "src1" if i % 3 else "src2", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    cfg = mixing.MixConfig(domain_weights={}, lang_weights={}, source_weights={"src1": 1, "src2": 9}, budget_share=0.7, max_epochs=3)
    pick = lambda c: sorted((r["doc_id"], r["epoch"]) for r in mixing.select_mixture(docs, c, domain=lambda s: mixing.F.lit("d")).collect())
    whole = pick(cfg)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert pick(cfg) == whole
    assert pick(mixing.MixConfig({}, {}, cfg.source_weights, 0.7, 3, seed=8)) != whole
    got = mixing.select_mixture(docs, cfg, domain=lambda s: mixing.F.lit("d")).collect()
    for source in ("src1", "src2"):
        mine = [r for r in got if r["source"] == source]
        used, quota = sum(r["n_tokens"] for r in mine), mine[0]["leaf_quota"]
        assert quota - 9 < used <= quota
        size = sum(1 for r in rows if r[3] == source)
        epochs = defaultdict(int)
        for r in mine:
            epochs[r["epoch"]] += 1
        assert all(epochs[e] == size for e in range(max(epochs)))


def test_edges(spark):
    got = mixing.select_mixture(edge_docs(spark), mixing.MixConfig(budget_share=10.0)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in EDGES for _ in range(2))
    assert {r["source"] for r in got} >= {"(none)", "src0"}
    assert mixing.select_mixture(empty_docs(spark)).count() == 0
    assert mixing.select_mixture(edge_docs(spark), mixing.MixConfig(budget_share=0.0)).where("n_tokens > 0").count() == 0


@pytest.mark.parametrize("share", [0.4, 1.0])
def test_mix_is_the_selection(spark, share):
    docs, cfg = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), mixing.MixConfig(budget_share=share)
    mixed = mixing.mix(docs, cfg)
    assert mixed.columns == docs.columns
    assert sorted(r["doc_id"] for r in mixed.select("doc_id").collect()) == sorted(r["doc_id"] for r in mixing.select_mixture(docs, cfg).collect())
