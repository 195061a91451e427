import random

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import pieces
from tests.llm.support import DOC_SCHEMA, edge_docs, empty_docs

VOCABULARY = pieces.Vocabulary.load(pieces.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
TEXT = st.text(st.one_of(st.sampled_from(" \n\tab▁ 日𝄞\x00"), st.characters(exclude_categories=["Cs"])), max_size=60)


@given(TEXT, st.integers(0, 5), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
@settings(max_examples=300, deadline=None)
def test_every_segmentation_decodes(text, seed, dropout):
    encoder = pieces.Encoder(VOCABULARY, seed, dropout, 2)
    assert pieces.decode(encoder(text, seed % 2).tolist(), VOCABULARY) == text.encode()


@given(TEXT.filter(lambda t: "▁" not in t))
@settings(max_examples=300, deadline=None)
def test_without_dropout_as_the_library(text):
    assert pieces.Encoder(VOCABULARY, 0, 0.0, 1)(text, 0).tolist() == LIBRARY.encode(text)


def test_rate_and_variety():
    text = "the quick brown foxes were jumping over several lazy dogs yesterday evening " * 20
    plain = pieces.Encoder(VOCABULARY, 0, 0.0, 1)(text, 0)
    seen = {s: tuple(pieces.Encoder(VOCABULARY, s, 0.3, 1)(text, 0).tolist()) for s in range(8)}
    assert len(set(seen.values())) == 8 and all(len(x) > len(plain) for x in seen.values())
    assert seen[3] == tuple(pieces.Encoder(VOCABULARY, 3, 0.3, 1)(text, 0).tolist())
    alone = pieces.Encoder(VOCABULARY, 0, 1.0, 1)("word", 0)
    assert len(alone) == 5
    draws = [pieces.draw(9, 12345678, 1, i) / 2**32 for i in range(4000)]
    assert abs(sum(d < 0.1 for d in draws) / 4000 - 0.1) < 0.02


def test_cache_does_not_change_pieces(monkeypatch):
    text = " ".join(f"word{i % 90}" for i in range(700))
    want = pieces.Encoder(VOCABULARY, 5, 0.2, 1)(text, 0).tolist()
    monkeypatch.setattr(pieces, "CACHE", 3)
    assert pieces.Encoder(VOCABULARY, 5, 0.2, 1)(text, 0).tolist() == want


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    coded = pieces.encode(docs, seed=4)
    back = pieces.decode_texts(coded).withColumnRenamed("text", "again").join(docs, "doc_id")
    assert coded.where("not lossless").count() == 0 and back.where("again = text").count() == docs.count()


def test_edges(spark):
    docs = edge_docs(spark)
    got = pieces.encode(docs, keep=docs.columns)
    assert got.columns == [*[c for c in docs.columns if c != "pieces"], "pieces", "n_pieces", "lossless"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(r["lossless"] and r["n_pieces"] == len(r["pieces"]) for r in rows)
    assert {tuple(r["pieces"]) for r in rows if r["doc_id"] in (3, 4)} == {()} and len({tuple(r["pieces"]) for r in rows if r["doc_id"] == 9}) == 1
    back = sorted((str(r["doc_id"]), r["text"]) for r in pieces.decode_texts(pieces.encode(docs)).collect())
    assert back == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert pieces.encode(empty_docs(spark)).count() == 0


@given(TEXT, st.integers(0, 5), st.sampled_from([0.0, 0.1, 0.5, 1.0]))
@settings(max_examples=200, deadline=None)
def test_as_each_word_alone(text, seed, dropout):
    """The courses kept by word give what the agenda gives under each word's key."""
    encoder = pieces.Encoder(VOCABULARY, seed, dropout)
    units = []
    for part in encoder.parts(text):
        units += [part] if not part or (part[-1].isalnum() and len(part) <= pieces.LENGTH) else VOCABULARY.cut(part)
    keys = encoder.keys(np.full(len(units), 77), np.arange(len(units))).tolist()
    mark = [VOCABULARY.bytes_[b] for b in pieces.SPACE.encode()]
    want = [i for u, k in zip(units, keys) for i in (pieces.encode_part(u, VOCABULARY, k, dropout) if u else mark)]
    assert encoder(text, 77).tolist() == want


def test_every_occurrence_has_its_own_draws(spark):
    """One word many times over: cut in many ways in one text, at the expected rate, and differently in each document."""
    rows = [(i, "yesterday " * 2000, "", "", 0) for i in range(12)]
    coded = [tuple(r["pieces"]) for r in pieces.encode(spark.createDataFrame(rows, DOC_SCHEMA)).collect()]
    assert len(set(coded)) == 12
    encoder = pieces.Encoder(VOCABULARY, 0, pieces.DROPOUT)
    n, word, rng = 20_000, "▁yesterday", random.Random(1)
    plain = tuple(pieces.encode_part(word, VOCABULARY, 0, 0.0))
    seen = [tuple(x.tolist()) for x in encoder.many_texts(["yesterday"] * n, list(range(n)))]
    want = [tuple(pieces.encode_part(word, VOCABULARY, rng.getrandbits(32), pieces.DROPOUT)) for _ in range(n)]
    assert len(set(seen)) > 12 and abs(sum(x == plain for x in seen) - sum(x == plain for x in want)) / n < 0.02
    one = pieces.Encoder(VOCABULARY, 0, pieces.DROPOUT)
    cuts = {tuple(pieces.encode_part(word, VOCABULARY, k, pieces.DROPOUT)) for k in one.keys(np.full(2000, 5), np.arange(2000)).tolist()}
    assert len(cuts) > 12 and one("yesterday " * 2000, 5).tolist().count(plain[0]) < 2000


def test_words_are_not_run_one_by_one(monkeypatch):
    """Three thousand different words, many of them with skips: only those beyond the widest array have an agenda of their own."""
    calls, alone = [], pieces._agenda
    monkeypatch.setattr(pieces, "_agenda", lambda *a: calls.append(a[0]) or alone(*a))
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 20))) for _ in range(3000)) + " " + "in" * 40 + "!"
    coded = pieces.Encoder(VOCABULARY, 0, pieces.DROPOUT)(text, 7)
    assert pieces.decode(coded.tolist(), VOCABULARY) == text.encode()
    assert len(calls) <= 3 and all(len(c) > pieces.WIDTHS[-1] for c in calls)


def test_words_of_every_width(monkeypatch):
    """Arrays of all widths, words beyond them, and blocks of a few words give what each word's agenda gives."""
    rng = random.Random(4)
    text = "\n".join(" " * rng.randint(0, 3) + "".join(rng.choices("interaon", k=k)) + rng.choice(["", ".", "▁", "日"]) for k in range(1, 90) for _ in range(4))
    for dropout in (0.0, 0.1, 0.6):
        encoder = pieces.Encoder(VOCABULARY, 1, dropout)
        units = []
        for part in encoder.parts(text):
            units += [part] if not part or (part[-1].isalnum() and len(part) <= pieces.LENGTH) else VOCABULARY.cut(part)
        keys = encoder.keys(np.full(len(units), 5), np.arange(len(units))).tolist()
        mark = [VOCABULARY.bytes_[b] for b in pieces.SPACE.encode()]
        want = [i for u, k in zip(units, keys) for i in (pieces.encode_part(u, VOCABULARY, k, dropout) if u else mark)]
        assert encoder(text, 5).tolist() == want
        monkeypatch.setattr(pieces, "CACHE", 100)
        assert [x.tolist() for x in encoder.many_texts(["", text, "", "a"], [0, 5, 1, 2])][:3] == [[], want, []]
        monkeypatch.undo()
