"""Language identification by fusing evidence in Bayes' rule.

Four kinds of evidence speak for a language: how likely its n-grams make the
text, which language the markup declares, what the address ends in, and which
languages the host has served before. The last comes from grouped counts,
smoothed level by level: a host leans on its domain, a domain on all pages. One more
class, "und", stands for bytes that are no language; what it wins is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.session import materialise
from loomline.llm import packed

LANGUAGES = ("de", "en", "es", "fr")
UND = "und"
BUCKET_BITS = 15  # hashed byte trigrams of the text model: fixed size
EVIDENCE = 50  # n-grams that a text counts for at most: neighbouring n-grams are not independent
UND_PRIOR = 0.01
LEAN_HOST, LEAN_DOMAIN, LEAN_SUFFIX = 20.0, 50.0, 50.0  # pages' worth of trust in the level above
ACCEPT = 0.5  # posterior below which no language is named
SLICE_BYTES = 1 << 20  # an array of a slice takes eight times that

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[packed.SPACE] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True


def _buckets(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around letters, and the text of each; a space stands before and after a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    here, edge = _FOLD[data], np.flatnonzero(owner[1:] != owner[:-1])
    before, after = np.roll(here, 1), np.roll(here, -1)
    before[0] = after[-1] = before[edge + 1] = after[edge] = 32
    keep = _LETTER[data]
    code = (before[keep] << np.uint64(16)) | (here[keep] << np.uint64(8)) | after[keep]
    return ((code * packed.ODD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owner[keep]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        step = max(1, len(batch) * SLICE_BYTES // max(SLICE_BYTES, batch.nbytes))
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            data, offsets = packed.text_bytes(part.column(0))
            bucket, owner = _buckets(data, np.repeat(np.arange(len(part)), np.diff(offsets)))
            yield part, bucket, owner


def _count(languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
        for part, bucket, owner in _parts(batches):
            label = np.array([languages.index(x) if x in languages else -1 for x in part.column(1).to_pylist()])[owner] if len(owner) else np.zeros(0, int)
            known = label >= 0
            total += np.bincount(label[known] * (1 << BUCKET_BITS) + bucket[known], minlength=total.size).reshape(total.shape)
        place = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total.ravel()[place])], names=["place", "n"])

    return run


def text_model(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """log p(trigram | language), and of "und" in the last row, from texts with a declared language.

    Counted over all texts; the table has languages * 2^15 places whatever the input.
    """
    counts = rows.select("text", "declared").mapInArrow(_count(languages), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    table = np.full((len(languages) + 1) << BUCKET_BITS, 0.5)
    for place, n in counts:
        table[place] += n
    table = table.reshape(len(languages) + 1, -1)
    return np.log(table / table.sum(1, keepdims=True))


def _likelihoods(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for part, bucket, owner in _parts(batches):
            m = len(part)
            n = np.bincount(owner, minlength=m)
            fit = np.stack([np.bincount(owner, weights=row[bucket], minlength=m) for row in table], axis=1).astype(float)
            fit *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
            keep = [i for i, c in enumerate(part.schema.names) if c != "text"]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * fit.shape[1]), pa.array(fit.ravel()))
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(n), flat], names=[*[part.schema.names[i] for i in keep], "n_grams", "fit"])

    return run


def address_parts(address: Column) -> dict[str, Column]:
    """Host, domain (its last two labels) and suffix (its last label; "" without a dot) of an address or a bare source name."""
    host = F.lower(F.regexp_extract(F.coalesce(address.cast("string"), F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return {"host": host, "domain": F.coalesce(F.nullif(F.regexp_extract(host, "([^.]+\\.[^.]+)$", 1), F.lit("")), host), "suffix": F.regexp_extract(host, "\\.([^.]+)$", 1)}


def _argmax(values: list[Column], names: list[str]) -> Column:
    """Name of the largest value, the first of equal ones."""
    top = F.greatest(*values)
    return reduce(lambda rest, pair: F.when(pair[0] == top, F.lit(pair[1])).otherwise(rest), list(zip(values, names))[::-1], F.lit(None).cast("string"))


def identify(texts: DataFrame, languages: tuple[str, ...] = LANGUAGES, keep: list[str] | None = None) -> DataFrame:
    """Language of every row of ``texts`` (doc_id, text, markup, address): doc_id, language, posterior, text_language, declared, host, n_grams, accepted.

    markup: the language that a page declares, read as its first subtag; one
    outside ``languages`` counts as none. address: a URL, host or source name.
    posterior is that of language, after all evidence; text_language is
    what the text alone says. Counts of a row's own group leave the row itself out.

    The model knows ``languages`` (a parameter) and learns their n-grams from the
    texts that declare one, and how far declarations, suffixes, domains and
    hosts can be trusted from what the texts alone say.

    A null or empty text, or one without letters, has no n-grams: it is "und"
    and not accepted. Null markup is no declaration; a null address is the host "".
    Repeated rows are judged alike, extra columns are ignored but for those of ``keep``, equal posteriors go to
    the first language in order, and an empty table gives no rows.
    """
    spark, names, keep = texts.sparkSession, [*languages, UND], keep or []
    code = F.lower(F.regexp_extract(F.trim(F.coalesce(F.col("markup").cast("string"), F.lit(""))), "^([A-Za-z]+)", 1))
    rows = texts.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.when(code.isin(*languages), code).otherwise(F.lit("")).alias("declared"),
                        *[c.alias(k) for k, c in address_parts(F.col("address")).items()], *keep)
    model = spark.sparkContext.broadcast(text_model(rows, languages))
    out = T.StructType([f for f in rows.schema if f.name != "text"]).add("n_grams", T.LongType()).add("fit", T.ArrayType(T.DoubleType()))
    read = rows.mapInArrow(_likelihoods(model), out)
    read = read.withColumn("guess", F.when(F.col("n_grams") == 0, UND).otherwise(_argmax([F.get("fit", F.lit(i)) for i in range(len(names))], names)))
    read = materialise(read, "langid_read")

    # What the texts alone say, counted by everything that is grouped on; all levels come from this table.
    cube = materialise(read.groupBy("host", "domain", "suffix", "declared", "guess").agg(F.count("*").alias("n")), "langid_counts")

    def level(keys: list[str], to: str) -> DataFrame:
        return cube.groupBy(*keys).agg(F.array(*[F.sum(F.when(F.col("guess") == x, F.col("n")).otherwise(0)) for x in names]).alias(to))

    every = level([F.lit(1).alias("one")], "n_all").collect()
    overall = np.array(every[0]["n_all"], float) if every else np.zeros(len(names))
    share = (overall[:-1] + 1) / (overall[:-1].sum() + len(languages))
    base = [*(share * (1 - UND_PRIOR)), UND_PRIOR]
    hosts = level(["host", "domain", "suffix"], "n_host").join(level(["domain", "suffix"], "n_domain"), ["domain", "suffix"]).join(level(["suffix"], "n_suffix"), ["suffix"])
    hosts = materialise(hosts, "langid_hosts")
    told = {r["declared"]: r["n_told"] for r in level(["declared"], "n_told").collect()}  # at most one row per language and one for none
    met = read.join(hosts, ["host", "domain", "suffix"])
    logs = []
    for i, x in enumerate(names):
        own = (F.col("guess") == x).cast("double")
        # A suffix leans on all pages, a domain on its suffix, a host on its domain; the row itself is left out everywhere.
        prior = F.lit(float(base[i]))
        for counts, lean in (("n_suffix", LEAN_SUFFIX), ("n_domain", LEAN_DOMAIN), ("n_host", LEAN_HOST)):
            total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) - 1
            prior = (F.get(counts, F.lit(i)) - own + F.lit(lean) * prior) / (total + F.lit(lean))
        # How often texts of this language carry this declaration.
        whole = sum(float(v[i]) for v in told.values())
        declared = F.lit(1.0)
        for d, counts in told.items():
            declared = F.when(F.col("declared") == d, (F.lit(float(counts[i])) - own + 0.5) / (F.lit(whole) - own + 0.5 * (len(languages) + 1))).otherwise(declared)
        logs.append(F.get("fit", F.lit(i)) + F.log(prior) + F.log(declared))
    met = met.select("doc_id", "declared", "host", "n_grams", F.col("guess").alias("text_language"), F.array(*logs).alias("log"), *keep)
    met = met.withColumn("weight", F.transform("log", lambda x: F.exp(x - F.array_max("log"))))
    met = met.withColumn("posterior", 1 / F.aggregate("weight", F.lit(0.0), lambda a, b: a + b))
    found = F.when((F.col("n_grams") > 0) & (F.col("posterior") >= ACCEPT), _argmax([F.get("log", F.lit(i)) for i in range(len(names))], names)).otherwise(F.lit(UND))
    met = met.withColumn("language", found).withColumn("accepted", F.col("language") != UND)
    return met.select("doc_id", "language", "posterior", "text_language", "declared", "host", "n_grams", "accepted", *keep)


def of_documents(docs: DataFrame, **more: Column) -> DataFrame:
    """The evidence that the table documents has: its lang is what was declared, its source the host. ``more``: further columns by name."""
    return docs.select("doc_id", "text", F.col("lang").alias("markup"), F.col("source").alias("address"), *[c.alias(k) for k, c in more.items()])


def of_pages(pages: DataFrame) -> DataFrame:
    """The evidence that a raw page has: the lang attribute of its html element, its URL, and the text between its tags."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), F.regexp_extract(html, "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([A-Za-z-]+)", 1).alias("markup"), F.col("url").alias("address"))
