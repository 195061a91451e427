import gzip
import hashlib
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomline.llm import warc

SCHEMA = "page_id long, url string, html string"


@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunked_round_trip(body, size):
    assert warc.dechunked(warc.chunked(body, size)) == body


@pytest.mark.parametrize("framed", [b"", b"5\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\n"])
def test_broken_framing_is_refused(framed):
    with pytest.raises(ValueError):
        warc.dechunked(framed)


ROWS = [
    (3, "http://a/", "x" * 200), (1, "http://b/\r\nX: y", "x" * 200), (2, None, "x" * 200), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
    (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\n" * 20), (9, "u", "é日𝄞\x00" * 30_000), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100),
    (14, "u", "same"), (14, "u", "same"), (None, "u", "z" * 150), (None, "u", "x" * 200),
]


def brute(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        again = len(body) >= 100 and same and i != min(same)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(same) if again else None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, parts):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("!") for c in ("payload", "digest", "value", "kind", "block", "first_id")}).repartition(parts)
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault").collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)
    assert warc.round_trip(pages.where("false")).count() == 0


def archives(path):
    return b"".join(gzip.open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))


def test_segments_are_in_many_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), path, segment=512)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) > 20
    back = {r["page_id"]: r for r in warc.read_archives(spark, path).where("page_id in (4, 9)").collect()}
    assert back[9]["segments"] > 100 and bytes(back[9]["payload"]).decode() == ROWS[8][2] and bytes(back[4]["payload"]) == b""


def damage(path, out, change):
    os.makedirs(out)
    with gzip.open(os.path.join(out, "part-0.gz"), "wb") as f:
        f.write(change(archives(path)))
    return out


def test_faults_are_told(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame([(1, "u", "q" * 5000)], SCHEMA).coalesce(1), path, segment=1024)
    whole = archives(path)
    records = [b"WARC/1.1" + r for r in whole.split(b"WARC/1.1")[1:]]
    assert len(records) == 5
    cases = {"missing": [r for k, r in enumerate(records) if k != 2], "repeated": [*records, records[3]], "last": records[:-1], "origin": records[1:], "bytes": [r.replace(b"qqqq", b"qqqz", 1) if k == 1 else r for k, r in enumerate(records)]}
    for name, kept in cases.items():
        row = warc.read_archives(spark, damage(path, str(tmp_path / name), lambda _: b"".join(kept))).first()  # noqa: B023
        assert row["page_id"] == 1 and row["payload"] is None and row["fault"], name
    mixed = warc.read_archives(spark, damage(path, str(tmp_path / "order"), lambda _: b"".join(records[::-1]))).first()
    assert mixed["fault"] is None and len(mixed["payload"]) == 5000
