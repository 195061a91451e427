import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import repeats
from tests.llm.support import DOC_SCHEMA, EDGES, edge_docs, empty_docs


def brute(rows, width):
    """Every substring of every text, in order of id and text."""
    seen, out = set(), []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            if data[i:i + width] in seen:
                gone[i:i + width] = True
            seen.add(data[i:i + width])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((doc_id, len(data), [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])], bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def answers(frame):
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in frame.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=60, max_size=400), st.integers(0, 2**31))
def test_factor_array(letters, seed):
    body = np.array(letters, np.uint8)
    if seed % 2:  # with long repeats
        body = np.concatenate((body, body[10:50], body[:30]))
    starts = np.sort(np.random.default_rng(seed).choice(len(body) - 39, min(30, len(body) - 39), replace=False))
    got = repeats.longest_previous_factors(body, starts, 40)
    for i, a in enumerate(starts):
        want = max((next((k for k in range(40) if body[a + k] != body[b + k]), 40) for b in starts[:i]), default=0)
        assert got[i] == want


def rows_with_copies(n, seed):
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "é", "the", "of", "zeta", "日本"] + [f"w{i}" for i in range(200)]
    say = lambda k: " ".join(words[i] for i in rng.integers(0, len(words), k))
    shared, line = [say(int(k)) for k in rng.integers(8, 60, 6)], say(12)
    rows = []
    for i in range(n):
        text = say(int(rng.integers(0, 30)))
        for _ in range(rng.integers(0, 4)):
            text += " " + (line if rng.random() < 0.5 else shared[rng.integers(0, 6)]) + " " + say(int(rng.integers(0, 12)))
        rows.append((i, text, "en", "s", 1))
    rows += [(n + i, rows[int(rng.integers(0, n))][1], "en", "s", 1) for i in range(n // 4)] + [(2 * n, "ab" * 700, "en", "s", 1), (2 * n + 1, "x" + "ab" * 300, "en", "s", 1), (2 * n + 2, "z" * 1000, "en", "s", 1)]
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("hot", [1, 6, 4096])
@pytest.mark.parametrize("width", [40, 100])
def test_against_every_substring(spark, monkeypatch, hot, width):
    rows = rows_with_copies(120, hot * width)
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    assert answers(repeats.drop_repeats(docs, width, 2000, hot)) == brute(rows, width)


def test_texts_cut_into_parts(monkeypatch):
    """The same segments' worth of starts, whatever the size of a part."""
    from loomline.llm import packed

    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    row = {"batch": "a", "ids": [1, 2], "first_row": 0, "ties": packed.squeezed(np.array([3, 4])), "lengths": packed.squeezed(np.array([4000, 1000])), "body": packed.squeezed(data)}
    covered = []
    for part in (1 << 20, 700, 64):
        monkeypatch.setattr(repeats, "PART", part)
        batch = repeats._Batch(row)
        batch.segments(100)
        covered.append(sorted((d, s + k) for d, s, c in zip(batch.doc.tolist(), batch.start.tolist(), batch.count.tolist()) for k in range(c)))
    assert covered[0] == covered[1] == covered[2] == [(0, i) for i in range(3901)] + [(1, i) for i in range(901)]


def test_small_parts_give_the_same_result(spark, monkeypatch):
    rows = rows_with_copies(80, 7)
    text = rows[0][1] + " and so on " * 40
    rows += [(1000, text * 3, "", "", 1), (1001, "q" + text * 2, "", "", 1)]
    import pyarrow as pa

    from loomline.llm import packed

    def parts(step):
        monkeypatch.setattr(repeats, "PART", step)
        texts = [r[1] for r in sorted(rows)]
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in sorted(rows)]), pa.array([t.encode() for t in texts]), pa.array(np.zeros(len(rows), np.int64))], names=["doc_id", "text", "tie"])
        monkeypatch.setattr(repeats.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
        made = [x for b in repeats._batches(1 << 20)(iter([batch])) for x in [b.to_pylist()[0]]]
        asked = pa.Table.from_batches(list(repeats._ask(100, 1)(iter([pa.RecordBatch.from_pylist(made)]))))
        told = repeats._judge(4)(asked)
        sent = pa.Table.from_batches(list(repeats._send(100, 1, 1, 1)(iter([pa.RecordBatch.from_pylist([{**made[0], "answers": told.select(["owner", "told"]).to_pylist()}])]))))
        marks = [m for m in sent.to_pylist() if m["kind"] == 0]
        for kind, f in ((1, repeats._factors(100)), (2, repeats._single(100))):
            some = sent.filter(pa.compute.equal(sent["kind"], kind))
            marks += f(some).to_pylist() if len(some) else []
        out = next(repeats._cut(iter([pa.RecordBatch.from_pylist([{**made[0], "marks": [m["data"] for m in marks if m["n"]]}])])))
        return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"]) for r in out.to_pylist()), key=str)

    want = brute(rows, 100)
    assert parts(1 << 20) == want and parts(500) == want and parts(97) == want
    assert packed.SLICE


def test_edges(spark):
    rows = [(1, "same " * 40, "", "", 1), (1, "same " * 40, "", "", 1), (None, "other " * 30, "", "", 1), (5, "other " * 30, "", "", 1)]
    got = answers(repeats.drop_repeats(spark.createDataFrame(rows, DOC_SCHEMA)))
    assert sorted(((r[0], r[1], r[1] - len(r[3])) for r in got), key=str) == [(1, 200, 195), (1, 200, 200), (5, 180, 174), (None, 180, 180)]
    got = repeats.repeat_digests(repeats.drop_repeats(edge_docs(spark))).collect()
    assert len(got) == len(EDGES) and {r["doc_id"]: r["n_removed"] for r in got}[7] == len(EDGES[6][1]) > 0
    assert repeats.drop_repeats(empty_docs(spark)).count() == 0
