"""Cleaning and mixing a corpus: five stages, each on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.session import materialise
from loomline.llm import exact, jaccard, langid, mixing, pieces


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; what is no language at all goes."""
    key = F.xxhash64(docs["text"], docs["lang"], docs["source"])
    judged = langid.identify(langid.of_documents(docs, _key=key), keep=["_key"])
    gone = judged.where("not accepted").select(F.col("doc_id").alias("_gone"), "_key").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (key == gone["_key"]), "left_anti")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest id."""
    groups = jaccard.jaccard_components(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mixture; a document of a second epoch comes twice."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces."""
    return pieces.encode(docs, keep=docs.columns)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode_pieces", encode_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs


# Language likelihoods over hashed n-grams and merge-dropout have no SQL form; tests/llm checks the stages against brute force.
ORACLE_SQL = None
