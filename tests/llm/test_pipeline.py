"""Every stage of the pipeline on its own input, against plain Python."""

import re

import pytest

import corpus_pipeline as pipeline
from loomline.llm import langid, mixing, pieces
from tests.llm import test_jaccard, test_langid
from tests.llm.support import edge_docs, empty_docs

SF = "/root/testdata/sf0.001"


def key(r):
    return tuple(map(str, r))


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        out.append(docs.collect())
    return out


def test_language_stage(steps):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in steps[0]]
    want = {w[0] for w in test_langid.brute(rows) if w[7]}
    assert sorted(map(key, steps[1])) == sorted(key(r) for r in steps[0] if r["doc_id"] in want)


def test_exact_stage(steps):
    first = {}
    for r in sorted(steps[1], key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r)
    assert sorted(map(key, steps[2])) == sorted(map(key, first.values()))


def test_near_stage(steps):
    groups = test_jaccard.brute([tuple(r) for r in steps[2]])
    keep = {i for i, _, c in groups if i == c}
    assert sorted(map(key, steps[3])) == sorted(key(r) for r in steps[2] if r["doc_id"] in keep)


def test_mixing_stage(spark, steps):
    chosen = sorted(r["doc_id"] for r in mixing.select_mixture(spark.createDataFrame(steps[3])).collect())
    assert sorted(r["doc_id"] for r in steps[4]) == chosen and {key(r) for r in steps[4]} <= set(map(key, steps[3]))


def test_pieces_stage(steps):
    vocabulary = pieces.Vocabulary.load(pieces.MODEL)
    assert len(steps[5]) == len(steps[4])
    for r in steps[5]:
        assert r["lossless"] and pieces.decode(r["pieces"], vocabulary) == r["text"].encode()


def test_run_is_the_stages(spark, steps):
    got = pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in steps[5])


def test_odd_tables_pass_through_every_stage(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "encode_pieces":
                assert docs.columns == columns
        docs.count()


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gone = docs.join(pipeline.language_id(spark, docs, SF), "doc_id", "left_anti")
    assert gone.where("length(text) > 20").count() == 0
    assert langid.ACCEPT == 0.5
