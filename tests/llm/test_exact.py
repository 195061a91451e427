import hashlib
import re
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from loomline.llm import exact, packed
from tests.llm.support import DOC_SCHEMA, EDGES, edge_docs, empty_docs


@given(st.lists(st.integers(0, 2**64 - 1), max_size=300))
def test_golomb_round_trip(values):
    values = np.sort(np.array(values, np.uint64))
    assert (packed.ungolomb(packed.golomb(values)) == values).all()


def test_golomb_is_short():
    values = np.unique(np.random.default_rng(1).integers(0, 2**40, 5000, dtype=np.uint64))
    assert len(packed.golomb(values)) < len(values) * 4.2


def test_words_hash_like_their_bytes():
    import pyarrow as pa

    texts = ["Ab cd  ab", None, "", "cd\x0bAB é", " x"]
    h, owner = packed.word_hashes(*packed.text_bytes(pa.array(texts)))
    assert owner.tolist() == [0, 0, 0, 3, 3, 3, 4] and h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 4


def test_words_are_the_same_in_small_slices(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab \n"), int(n))) for n in rng.integers(0, 90, 60)]
    want = packed.word_hashes(*packed.text_bytes(pa.array(texts)))
    monkeypatch.setattr(packed, "SLICE", 7)
    data, offsets = packed.text_bytes(pa.array(texts))
    monkeypatch.setattr(packed, "slices", lambda d, o, f=packed.slices: f(d, o, 7))
    got = packed.word_hashes(data, offsets)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and len(want[0]) == sum(len(t.split()) for t in texts)


def brute(rows):
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    for r, t in zip(rows, norm):
        groups[t].append(r[0])
    out = []
    for r, t in zip(rows, norm):
        known = [x for x in groups[t] if x is not None]
        out.append((r[0], min(known) if known else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=str)


def test_edges(spark):
    got = exact.exact_groups(edge_docs(spark)).collect()
    assert order([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got]) == order(brute(EDGES))
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, 3, 5, 6, 8, 9, 10, None]))
    assert exact.exact_groups(empty_docs(spark)).count() == 0


def test_same_print_without_same_text(spark, monkeypatch):
    """Owners that only see a few distinct prints mark every row; bytes still decide."""
    rows = [(i, f"text {i % 7}", "en", "s", 1) for i in range(40)] + [(None, "text 3", "en", "s", 1)]
    marks = exact.fingerprints(spark.createDataFrame(rows, DOC_SCHEMA).repartition(5), 3)
    assert marks.where("not suspect").count() == 0
    got = exact.exact_groups(spark.createDataFrame(rows, DOC_SCHEMA).repartition(5), owners=3).collect()
    assert order([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got]) == order(brute(rows))
    assert sorted(r["doc_id"] for r in got if r["kept"]) == list(range(7))


def test_digest_clash_is_told_apart(spark, monkeypatch):
    """With a digest of one value for all texts, the texts themselves form the groups."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.concat(F.lit("00" * 32), F.substring(F.lit(""), 1, 0)) if True else c)
    rows = [(1, "a", "", "", 1), (2, "b", "", "", 1), (3, "a", "", "", 1), (4, "c", "", "", 1)]
    got = exact.exact_groups(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    assert order([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got]) == order([(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)])


def test_copies_are_dropped_with_all_columns(spark):
    docs = edge_docs(spark)
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(map(str, [1, 2, 3, 5, 6, 8, 9, 10, None]))
