import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import packed, quality
from tests.llm.support import CLASHES, edge_docs, empty_docs

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def scored(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    return read("labels").join(quality.score_quality(read("documents"), read("labels")), "doc_id").toPandas()


def area(label, score):
    rank = score.rank()
    ones = label == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_accuracy(scored):
    held = scored[scored.held_out]
    assert len(held) > 500 and area(held.quality, held.score) > 0.97
    assert (held.predicted == held.quality).mean() > 0.95 and held[held.quality == 1].predicted.mean() > 0.97


def test_held_out_rows_by_checksum(scored):
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(scored.doc_id, scored.held_out))
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.7) == (scored.predicted == 1)).all()


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    run = lambda x: sorted(map(tuple, quality.score_quality(docs, x).collect()))
    assert run(labels) == run(other)


def test_votes_against_loops():
    rng = np.random.default_rng(1)
    voters, rows, labels = quality.unit(rng.standard_normal((40, 6))), quality.unit(rng.standard_normal((9, 6))), rng.integers(0, 2, 40).astype(float)
    got = quality.votes(rows, voters, labels, 7, 0.5)
    for r, g in zip(rows, got):
        near = sorted(((float(r @ v), y) for v, y in zip(voters, labels)), reverse=True)[:7]
        weight = [max(c, 0) ** quality.SHARPNESS for c, _ in near]
        assert abs(g - sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight)) < 1e-12


def test_blocks_do_not_change_terms():
    texts = ["Some text here.", "", None, "X!! Y!! Z!!", "a | b | c", "é" * 50, "again again again again"]
    whole = quality.term_rows(*packed.text_bytes(pa.array(texts)))
    each = np.concatenate([quality.term_rows(*packed.text_bytes(pa.array([t], pa.string()))) for t in texts])
    assert (whole == each).all()


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 0), (9, None, 0), (None, 1, 0), (777, 1, 0), (10, 1, 0)], LABELS)
    docs = edge_docs(spark)
    got = quality.score_quality(docs, labels.withColumnsRenamed({}).selectExpr("*", *[f"1 as `{c}`" for c in CLASHES if c not in ("score",)]))
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 9}) == 1
    assert {r["score"] for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(empty_docs(spark), labels).count() == 0


def test_ties_share_the_last_places_and_own_votes_do_not_count():
    voters, labels = np.eye(2)[[0, 1, 1, 1]], np.array([0.0, 1.0, 0.0, 0.0])
    rows = quality.unit(np.array([[0.6, 0.8], [0.6, 0.8]]))
    w0, w1 = 0.6**quality.SHARPNESS, 0.8**quality.SHARPNESS
    assert quality.votes(rows[:1], voters, labels, 2, 0.5)[0] == pytest.approx(1 / 3)  # two places for three equal voters
    assert quality.votes(rows[:1], voters, labels, 4, 0.5)[0] == pytest.approx(w1 / (3 * w1 + w0))
    got = quality.votes(rows, voters, labels, 3, 0.5, np.array([1, -1]))
    assert got == pytest.approx([0.0, 1 / 3])


def plain_terms(text):
    """Term counts of a text one by one."""
    data, out = (text or "").encode(), np.zeros(quality.TERMS)
    slot = lambda code, bits: ((code * int(packed.ODD)) % 2**64) >> (64 - bits)
    shape = lambda b: ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b
    for width, start, bits, of in ((3, 0, 11, lambda b: b), (4, quality.TRIGRAMS, 10, shape)):
        for i in range(len(data) - width + 1):
            code = 0
            for b in data[i:i + width]:
                code = (code * 257 + of(b)) % 2**64
            out[start + slot(code, bits)] += 1
    out = np.log1p(out)
    words = [w.lower() for w in data.split()]
    letters, capitals, digits = (sum(shape(b) in which for b in data) for which in ((ord("a"), ord("A")), (ord("A"),), (ord("0"),)))
    solid, n, m = sum(map(len, words)), max(len(data), 1), max(len(words), 1)
    shares = [letters / n, capitals / max(letters, 1), min(1, 4 * digits / n), min(1, 4 * (solid - letters - digits) / n), len(set(words)) / m,
              sum(a == b for a, b in zip(words, words[1:])) / m, min(1, solid / m / 16), min(1, np.log2(1 + len(words)) / quality.LEVELS)]
    for k, share in enumerate(shares):
        out[quality.TRIGRAMS + quality.SHAPES + k * quality.LEVELS + min(max(int(share * quality.LEVELS), 0), quality.LEVELS - 1)] = 1
    return out


def test_whole_query_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels, sample=12, rank=12, neighbours=5).collect()}
    from pyspark.sql import functions as F

    known = {r["doc_id"]: r["q"] for r in labels.groupBy("doc_id").agg(F.avg("quality").alias("q")).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    order = [r["l"] for r in spark.createDataFrame([(k,) for k in known], "l long").orderBy(F.xxhash64("l"), "l").limit(12).collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {d: plain_terms(t) for d, t in texts.items()}
    rarity = np.log((1 + len(rows)) / (1 + sum(r > 0 for r in rows.values()))) + 0.1
    for d, r in rows.items():
        r = r * rarity
        for a, b in ((0, quality.TRIGRAMS), (quality.TRIGRAMS, quality.TRIGRAMS + quality.SHAPES), (quality.TRIGRAMS + quality.SHAPES, quality.TERMS)):
            r[a:b] /= np.linalg.norm(r[a:b]) or 1
        rows[d] = r
    voters = sorted(d for d in order if d in rows)
    assert len(voters) > 2
    basis = np.linalg.svd(np.stack([rows[d] for d in voters]), full_matrices=False)[2]
    place = {d: (v := basis @ r) / np.linalg.norm(v) for d, r in rows.items()}
    for d in rows:
        near = sorted(((float(place[d] @ place[v]), known[v]) for v in voters if v != d), reverse=True)[:5]
        weight = [max(c, 0) ** quality.SHARPNESS for c, _ in near]
        assert got[d] == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight), abs=0.02)
