"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every task sends its sorted, compressed fingerprints to the owners of their
ranges; an owner answers each list with a bitmap of the values that other
lists hold too; only the texts behind those bits, and behind repeats inside
one list, are moved and compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.session import materialise
from loomline.llm import packed

CHUNK = 1 << 20  # documents in one list of a sender
OWNER_ROWS = 1 << 22

SENT = T.StructType([
    T.StructField("sender", T.StringType()), T.StructField("owner", T.IntegerType()), T.StructField("coded", T.BinaryType()),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("slots", T.BinaryType()), T.StructField("shas", T.BinaryType()),
])


def normalised(text: Column | str) -> Column:
    """White-space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _send(owners: int):
    def lists(ids: list, shas: list[bytes], name: str) -> Iterator[pa.RecordBatch]:
        raw = b"".join(shas)
        prints = np.frombuffer(raw, ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
        sha = np.frombuffer(raw, np.uint8).reshape(-1, 32)
        owner = ((prints >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(prints, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(owners + 1))
        rows = []
        for o in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[o]:cuts[o + 1]]
            values, slot = np.unique(prints[at], return_inverse=True)
            rows.append((name, int(o), packed.golomb(values), [ids[i] for i in at], slot.astype(np.uint32).tobytes(), sha[at].tobytes()))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()),
                 pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.binary())], names=SENT.names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, ids, shas = TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            shas += batch.column(1).to_pylist()
            if len(ids) >= CHUNK:
                yield from lists(ids, shas, f"{task}-{number}")
                number, ids, shas = number + 1, [], []
        if ids:
            yield from lists(ids, shas, f"{task}-{number}")

    return send


def _answer(table: pa.Table) -> pa.Table:
    """For every list of one owner the bits of the values that another list holds too."""
    lists = [packed.ungolomb(code) for code in table.column("coded").to_pylist()]
    values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = np.split((counts > 1)[inverse], np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "bits": pa.array([np.packbits(x).tobytes() for x in shared], pa.binary())})


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            slot = np.frombuffer(row["slots"], np.uint32)
            many = np.bincount(slot) > 1
            many |= np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=len(many)).astype(bool)
            sha = pa.Array.from_buffers(pa.binary(32), len(slot), [None, pa.py_buffer(row["shas"])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), sha, pa.array(many[slot])], names=["doc_id", "sha", "suspect"])


def fingerprints(docs: DataFrame, owners: int) -> DataFrame:
    """(doc_id, sha, suspect) for every row; suspect: some other row has the same fingerprint."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised("text").cast("binary"), 256)).alias("sha"))
    sent = materialise(keyed.mapInArrow(_send(owners), SENT), "fingerprints")
    bits = sent.select("sender", "owner", "coded").groupBy("owner").applyInArrow(_answer, "sender string, owner int, bits binary")
    met = sent.join(bits, ["sender", "owner"]).select("ids", "slots", "shas", "bits")
    return met.mapInArrow(_marks, "doc_id long, sha binary, suspect boolean")


def exact_groups(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id and text are read): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space; the
    smallest doc_id of a group stays.

    owners: ranges of fingerprints, by default the session's shuffle partitions
    and more where an owner would get over 4 million rows; an owner holds one value per list and distinct text, so a text
    that fills a third of the table costs it one value per list.

    Null or empty texts are equal to each other and form a group like any
    other. Of rows that repeat both id and text one is kept. A null doc_id
    sorts after all others: it stays only in a group without other ids, where
    keep_id is null. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    marks = materialise(fingerprints(docs, owners), "marks")
    suspects = marks.where("suspect").select(F.col("doc_id").alias("s_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised("text").alias("body"))
    moved = materialise(texts.join(suspects, texts.doc_id.eqNullSafe(suspects.s_id), "left_semi").withColumn("sha", F.unhex(F.sha2(F.col("body").cast("binary"), 256))), "suspects")
    # The text itself is a grouping key, so equality is of bytes; each task first merges its own copies.
    verified = materialise(moved.groupBy("sha", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "verified")
    one = verified.groupBy("sha").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    rows = marks.where("suspect").join(one, "sha")
    clear = rows.where("texts = 1").select("doc_id", "sha", "keep_id", "group_size", (F.col("group_size") > 1).alias("many"))
    # Different texts with one digest: told apart by the text itself.
    clash = moved.join(one.where("texts > 1").select("sha"), "sha", "left_semi").join(verified, ["sha", "body"]).select(
        "doc_id", "sha", "keep_id", "group_size", (F.col("group_size") > 1).alias("many"))
    alone = marks.where("not suspect").select("doc_id", "sha", F.lit(None).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(False).alias("many"))
    grouped = clear.unionByName(clash)
    # Of the rows that could stay one does; there is more than one only where a row is repeated.
    first = F.row_number().over(_same_row())
    stay = grouped.where("not many or doc_id <=> keep_id").withColumn("kept", first == 1)
    gone = grouped.where("many and not doc_id <=> keep_id").withColumn("kept", F.lit(False))
    every = stay.unionByName(gone).unionByName(alone.withColumn("kept", F.lit(True)))
    return every.select("doc_id", F.when(F.col("many"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _same_row():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "sha").orderBy("group_size")


def drop_copies(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only the rows of dropped ids and of repeated rows travel; the rest pass
    through one join whose other side is as small as the number of copies.
    """
    groups = materialise(exact_groups(docs, owners), "exact_groups")
    sha = "_sha" + "_" * max(map(len, docs.columns))  # a name that docs can not have
    mark = docs.withColumn(sha, F.sha2(normalised("text").cast("binary"), 256))
    # An id and text of which some row goes: either all its rows, or all but one.
    partly = groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.min("kept").alias("all_stay")).where("not all_stay")
    on = lambda d, p: d["doc_id"].cast("long").eqNullSafe(p["p_id"]) & (d[sha] == p["p_sha"])
    named = partly.select(F.col("doc_id").alias("p_id"), F.col("text_sha256").alias("p_sha"), "stays")
    whole = mark.join(named, on(mark, named), "left_anti")
    some = named.where("stays")
    repeated = mark.join(some, on(mark, some), "left_semi").dropDuplicates(["doc_id", sha])
    return whole.unionByName(repeated).drop(sha)


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
