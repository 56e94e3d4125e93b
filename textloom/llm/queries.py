"""The queries of this subpackage, each over its whole tables with production parameters, and their SQL where that is feasible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.storage import materialize, table
from textloom.llm.formatting_duplicates import copies, record_tuples
from textloom.llm.leakage import leaked_items, leaks
from textloom.llm.near_duplicates import near_duplicate_groups, near_duplicates, similar_pairs
from textloom.llm.oracles import SQL  # noqa: F401
from textloom.llm.reading_level import demanding, reading_levels
from textloom.llm.repetition import language, repetition, repetitive
from textloom.llm.shared_spans import shared_spans
from textloom.llm.source_mixing import mix, with_tokens
from textloom.llm.token_budget import fit, plain_name, token_budget

#: What a near-duplicate is for ``p4_found``: at least 0.6 of the three-word runs in common.
FOUND = {"threshold": 0.6, "shingle": 3, "min_words": 20}
#: For ``p4_groups``: at least 0.8 of the five-word runs in common, in texts of any length that has words.
GROUPS = {"threshold": 0.8, "shingle": 5, "min_words": 1}


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return copies(record_tuples(table(spark, sf_dir, "documents"), table(spark, sf_dir, "text_meta")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir)[1]


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record: the document kept and the number of copies."""
    return _copies(spark, sf_dir)[0]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


def p2_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every document: characters, shared characters and their share."""
    docs = table(spark, sf_dir, "documents")
    spans = shared_spans(docs).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    every = docs.select("doc_id", size.alias("n_chars")).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    every = every.join(spans, "doc_id", "left").fillna(0, ["shared_chars", "n_spans"])
    return every.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))


def p3_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget(table(spark, sf_dir, "documents"), table(spark, sf_dir, "text_meta"), table(spark, sf_dir, "tokenizer_merges"))


def p3_holdouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the models predict documents that they were not fitted on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", plain_name(F.col("source")).alias("source"), language(F.col("lang")).alias("language"))
    return fit(docs, table(spark, sf_dir, "tokenizer_merges"))[1]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(*near_duplicates(table(spark, sf_dir, "documents"), **FOUND))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents at the usual measure: five-word runs, similarity 0.8. Texts of fewer than five words are grouped with their copies."""
    docs = table(spark, sf_dir, "documents")
    return near_duplicate_groups(*near_duplicates(docs, **GROUPS), docs)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``p5_repetition`` at least half of whose words are repeated; their number decides, the distances don't."""
    return repetitive(p5_repetition(spark, sf_dir)).select("doc_id")


def p5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: share of words in repeated runs, and divergence from its language."""
    return repetition(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(leaks(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), edits=0))


def p6_partial_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents with a run of at most two edits, and how many of the item's runs match."""
    return leaks(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(materialize(with_tokens(docs), "tokens"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents taken and how often, with the share that their source comes to."""
    chosen, report = _mix(spark, sf_dir)
    return chosen.join(F.broadcast(report.select(plain_name(F.col("source")).alias("source"), "target_share", "actual_share")), "source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``p8_reading_level`` with long sentences and many long words; these decide, the level doesn't."""
    return demanding(p8_reading_level(spark, sf_dir)).select("doc_id")


def p8_reading_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: estimated grade and surface measures."""
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_copies": p1_copies,
    "p2_found": p2_found,
    "p2_shared_share": p2_shared_share,
    "p3_token_budget": p3_token_budget,
    "p3_holdouts": p3_holdouts,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_repetition": p5_repetition,
    "p6_found": p6_found,
    "p6_partial_leaks": p6_partial_leaks,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_reading_level": p8_reading_level,
}
