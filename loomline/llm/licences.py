"""Licence scans: an exact containment join of text blocks with licence templates.

Tokens are ordered by how many documents hold them, rarest first. A block that
shares enough tokens with a template must hold one of the template's rarest
(prefix filter), have enough tokens at all (length filter) and have enough of
them left after the first shared one (positional filter); what passes is
counted exactly. Blocks are lines, or paragraphs and runs of words where texts
are wrapped. A run is only looked at in a text that holds enough of a
template's tokens as a whole. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.session import materialise

CONTAINMENT = 90  # per cent of a template's distinct tokens that a block must hold
SPAN = 2  # a run has this many times the words of a template, so words put in between do not hide it
BLANK = "\n[ \t\r]*\n"  # what stands between paragraphs

# Phrases with their labels, and templates as their wording.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit-notice": ("mit", "released under the mit license"),
    "mit-grant": ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    "apache-notice": ("apache", "licensed under the apache license version 2 0"),
    "apache-terms": ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    "gpl-notice": ("gpl", "this work is licensed under the gnu general public license version 3"),
    "gpl-terms": ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    "cc-by-nc-notice": ("cc-by-nc", "licensed under cc by nc 4 0"),
    "bsd-terms": ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
}
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(words: Column, phrase: str) -> Column:
    """Starts of the places where the words of ``phrase`` stand consecutively."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    hit = lambda i: F.expr("true") if not parts else _all([F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)])
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), hit)).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _scan(docs: DataFrame, vocabulary: list[str], least: int, between: str) -> DataFrame:
    """What one reading of the texts gives: counts, places of phrases, the template words of each block that has enough of them, and all words by block."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body")).withColumn(
        "lines", F.transform(F.split("body", between), lambda x: F.regexp_extract_all(F.translate(x, UPPER, LOWER), F.lit(WORD), F.lit(0))))
    # Words never hold a line end, so the words of the blocks are the words of the text.
    told = F.contains(F.lower("body"), F.lit("license"))
    lines = lines.withColumn("words", F.when(told, F.flatten("lines")).otherwise(F.array().cast("array<string>")))
    lines = lines.withColumn("n_words", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.size(x)))
    lines = lines.withColumn("blocks", F.transform("lines", lambda x: F.array_intersect(x, _strings(vocabulary))))
    places = lines.select("doc_id", "n_words", "lines", "blocks", *[_places(F.col("words"), p).alias(f"at{k}") for k, p in enumerate(PHRASES)])
    found = [F.col(f"at{k}") for k in range(len(PHRASES))]
    every = F.concat(*found)
    return places.select(
        "doc_id", "n_words", "lines", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(at) > 0, F.lit(label)) for at, label in zip(found, PHRASES.values())])).alias("base"),
        F.array_distinct(F.flatten("blocks")).alias("held"), F.filter("blocks", lambda b: F.size(b) >= least).alias("blocks"))


def _with_runs(scanned: DataFrame, wording: dict[str, list[str]], need: dict[str, int], vocabulary: list[str]) -> DataFrame:
    """The templates that a text as a whole has enough words of (near), and for texts with any the places of all template words (at)."""
    sides = F.array(*[F.struct(F.lit(name).alias("template"), _strings(words).alias("tokens"), F.lit(need[name]).alias("need")) for name, words in wording.items()])
    near = F.transform(F.filter(sides, lambda t: F.size(F.array_intersect(F.col("held"), t["tokens"])) >= t["need"]), lambda t: t["template"])
    placed = F.filter(F.transform(F.flatten("lines"), lambda w, i: F.struct(i.alias("i"), w.alias("word"))), lambda x: F.array_contains(_strings(vocabulary), x["word"]))
    return scanned.withColumn("near", near).withColumn("at", F.when(F.size("near") > 0, placed))


def _run_hits(scanned: DataFrame, plain: DataFrame) -> DataFrame:
    """Row, label, overlap and size for each text and template with a run of ``span`` consecutive words that holds enough of the template."""
    pairs = scanned.where(F.size("near") > 0).select("row", "at", F.explode("near").alias("template")).join(F.broadcast(plain), "template")
    own = pairs.withColumn("own", F.filter("at", lambda x: F.array_contains("tokens", x["word"]))).drop("at")
    # A best run may be taken to begin at a word of the template; no more such words than its length stand in it.
    held = lambda x, k: F.size(F.array_distinct(F.transform(F.filter(F.slice("own", k + 1, F.col("span")), lambda y: y["i"] < x["i"] + F.col("span")), lambda y: y["word"])))
    best = materialise(own.select("row", "label", "need", F.size("tokens").alias("size"), F.array_max(F.transform("own", held)).alias("overlap")), "licence_runs")
    return best.where("overlap >= need").select("row", "label", "overlap", "size")


def scan_licences(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, containment: int = CONTAINMENT, wrapped: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    docs: columns doc_id and text are read, others ignored.
    templates: name to (label, wording); a parameter, so its words are few by construction.
    containment: per cent of a template's distinct words that one block of a text must hold.
    wrapped: blocks are the paragraphs between blank lines and every run of
    ``SPAN`` times as many consecutive words as the template has, across line
    ends; else they are single lines. Whatever a line holds its paragraph holds.

    score is the largest share of a template found in a block that meets the
    threshold, 1 where a phrase stands, else 0. A null or empty text has no words,
    no places (null first and last), empty labels and score 0. Repeated rows give
    repeated rows. An empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    wording = {name: sorted(set(words.split())) for name, (_, words) in templates.items()}
    need = {name: -(-len(words) * containment // 100) for name, words in wording.items()}
    vocabulary = sorted({w for words in wording.values() for w in words})
    spark = docs.sparkSession
    scanned = _scan(docs, vocabulary, min(need.values(), default=0), BLANK if wrapped else "\n")
    if wrapped and templates:
        scanned = _with_runs(scanned, wording, need, vocabulary)
    scanned = scanned.drop("lines")
    scanned = materialise(scanned.withColumn("row", F.monotonically_increasing_id()), "licence_scan")
    if not templates:
        return _result(scanned.withColumn("found", F.array().cast("array<string>")).withColumn("best", F.lit(None).cast("double")))
    # Global order of the template words: rarest first, by documents that hold them.
    held = scanned.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    words = spark.createDataFrame([(w,) for w in vocabulary], "word string").join(held, "word", "left")
    ranked = words.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "word"))).alias("all")).select(F.col("all.word").alias("order"))
    plain = spark.createDataFrame([(name, templates[name][0], w, need[name], SPAN * len(templates[name][1].split())) for name, w in wording.items()], "template string, label string, tokens array<string>, need int, span int")
    # One row of a few hundred words beside a few templates.
    own = plain.withColumn("one", F.lit(1)).join(ranked.withColumn("one", F.lit(1)), "one").drop("one")
    own = own.withColumn("tokens", F.array_intersect("order", "tokens")).withColumn("size", F.size("tokens"))
    prefix = own.select("template", "label", "tokens", "size", "need", "order", F.posexplode(F.slice("tokens", F.lit(1), F.col("size") - F.col("need") + 1)).alias("place", "word"))
    prefix = materialise(prefix.withColumn("rank", F.array_position("order", F.col("word"))), "licence_prefixes")
    lines = scanned.select("row", F.posexplode("blocks").alias("line", "block")).withColumn("word", F.explode("block"))
    met = lines.join(prefix, "word").where(F.size("block") >= F.col("need"))
    rest = F.size(F.array_intersect("block", F.slice("order", F.col("rank") + 1, F.size("order"))))
    met = met.where(1 + F.least(F.col("size") - F.col("place") - 1, rest) >= F.col("need"))
    exact = met.withColumn("overlap", F.size(F.array_intersect("block", "tokens"))).where("overlap >= need")
    exact = exact.select("row", "label", "overlap", "size")
    if wrapped:
        exact = exact.unionByName(_run_hits(scanned, plain))
    hits = exact.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("overlap") / F.col("size")).alias("best"))
    return _result(scanned.join(hits, "row", "left"))


def _result(rows: DataFrame) -> DataFrame:
    found = F.coalesce("found", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
                       F.array_join(F.array_sort(F.array_union("base", found)), ",").alias("labels"),
                       F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _sql() -> str:
    def places(phrase: str) -> str:
        parts = phrase.split()
        ok = " AND ".join(f"lead(word, {k}) OVER (PARTITION BY r ORDER BY i) = '{p}'" if k else f"word = '{p}'" for k, p in enumerate(parts))
        return f"SELECT r, i, '{PHRASES[phrase]}' AS label FROM (SELECT r, i, ({ok}) AS hit FROM w) WHERE hit"

    wording = " UNION ALL ".join(f"SELECT '{n}' AS template, '{label}' AS label, unnest(list_distinct(string_split('{words}', ' '))) AS word" for n, (label, words) in TEMPLATES.items())
    extract = f"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '{WORD.replace(chr(92) * 2, chr(92))}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
a AS (SELECT r, doc_id, {extract.format("body")} AS ws, string_split(body, chr(10)) AS ls FROM d),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM a WHERE list_contains(ws, 'license')),
p AS ({" UNION ALL ".join(places(x) for x in PHRASES)}),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM p GROUP BY r),
t AS ({wording}),
z AS (SELECT template, label, count(*) AS size FROM t GROUP BY ALL),
l AS (SELECT r, unnest(range(len(ls))) AS line, unnest(ls) AS body FROM a),
lw AS (SELECT r, line, unnest(list_distinct({extract.format("body")})) AS word FROM l),
m AS (SELECT r, line, template, count(*) AS overlap FROM lw JOIN t USING (word) GROUP BY ALL),
h AS (SELECT r, label, max(overlap / size) AS best FROM m JOIN z USING (template) WHERE overlap * 100 >= size * {CONTAINMENT} GROUP BY r, label),
s AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels, max(best) AS best FROM (SELECT r, label, max(best) AS best FROM (SELECT r, label, best FROM h UNION ALL SELECT r, label, 0 FROM p) GROUP BY r, label) GROUP BY r),
bl AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM a LEFT JOIN b USING (r) LEFT JOIN s USING (r) LEFT JOIN bl USING (r)
"""


LICENCE_SQL = _sql()
