"""The dealt operators over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import ann, exact, jaccard, langid, licences, lm, mixing, periods, phrases, pieces, quality, repeats, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; declared language and source are its markup and host."""
    return langid.identify(langid.of_documents(_table(spark, sf_dir, "documents")))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every raw page from its text, html lang attribute, address suffix and host."""
    return langid.identify(langid.of_pages(_table(spark, sf_dir, "pages"))).withColumnRenamed("doc_id", "page_id")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and epochs that the weighted mixture takes."""
    return mixing.select_mixture(_table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probability of every text."""
    return lm.score_texts(_table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row that stays."""
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates found in every text."""
    return licences.scan_licences(_table(spark, sf_dir, "documents"), wrapped=True)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the votes of its nearest labelled neighbours."""
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under seeded merge-dropout."""
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components by five-word shingles."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two thousand strongest collocations of every language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without later copies of 100-byte substrings."""
    return repeats.repeat_digests(repeats.drop_repeats(_table(spark, sf_dir, "documents")))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words of every document, some with a planted tail, and the text without them."""
    return periods.run_digests(periods.periodic_runs(_table(spark, sf_dir, "documents"), periods.wrapped_tail))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_multi_index, op3_mix_sources, op4_lm_scores, op5_exact_dedup, op6_licences, op7_quality, op8_pieces, op9_jaccard, op10_warc, op11_phrases, op12_repeats, op13_periods, language_of_pages)}
ORACLES = {"op3_mix_sources": mixing.MIX_SQL, "op4_lm_scores": lm.LM_SQL, "op9_jaccard": jaccard.JACCARD_SQL, "op6_licences": licences.LICENCE_SQL, "op5_exact_dedup": exact.EXACT_SQL, "op10_warc": warc.WARC_SQL, "op11_phrases": phrases.PHRASES_SQL, "op12_repeats": repeats.REPEATS_SQL, "op13_periods": periods.PERIODS_SQL}
