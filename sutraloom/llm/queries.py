"""The queries of the ten corpus problems and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sutraloom.llm import copies, encoding, kinds, languages, leaks, lookalikes, packing, personal, scans, sitelines
from sutraloom.runtime import table

DOCS, WORDS = "ayurveda_docs_final", "final_language_dataset"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS)


def _both_texts(spark: SparkSession, d: str) -> DataFrame:
    """content and ascii under one roof: (tab, row_id, text)."""
    docs = _pages(spark, d).select(F.lit(DOCS).alias("tab"), F.col("rec_id").alias("row_id"), F.col("content").alias("text"))
    words = table(spark, d, WORDS).select(F.lit(WORDS).alias("tab"), F.col("word_id").alias("row_id"), F.col("ascii").alias("text"))
    return docs.unionByName(words)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.unify(_both_texts(spark, d), "text", only_changed=True).select("tab", "row_id").distinct()


def _maybe_scanned(spark: SparkSession, d: str) -> DataFrame:
    """Pages with `scanned`: by their source, null (the layout decides) where they have none."""
    kind = F.when(F.col("source").isNotNull(), F.col("source").contains("/scans/"))
    return _pages(spark, d).withColumn("scanned", kind)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_noise(_maybe_scanned(spark, d), "rec_id", "content", "scanned")


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(_maybe_scanned(spark, d), "rec_id", "content", "scanned")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair_encoding(_pages(spark, d), "rec_id", "content").select("rec_id")


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair_encoding(_pages(spark, d), "rec_id", "content")


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.unify(_both_texts(spark, d), "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.find_lines(_pages(spark, d), "rec_id", "source", "content")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.remove_lines(_pages(spark, d).select("rec_id", "source", "content"), "source", "content").select("rec_id", "content")


def _common(spark: SparkSession, d: str) -> frozenset[str]:
    return kinds.common_words(table(spark, d, "common_words"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    made = kinds.classify(_pages(spark, d), "rec_id", "content", _common(spark, d))
    return made.where(F.col("kind") != "prose").select("rec_id", "kind")


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return kinds.classify(_pages(spark, d), "rec_id", "content", _common(spark, d))


def _scanned(source) -> "F.Column":
    """Whether a record comes from a scanned book; null sources do not."""
    return F.coalesce(F.col(source).contains("/scans/"), F.lit(False))


def _languages(spark: SparkSession, d: str, whole_only: bool) -> DataFrame:
    pages = _pages(spark, d).withColumn("wrapped", _scanned("source"))
    return languages.detect(pages, "rec_id", "content", "lang", "wrapped", "source", whole_only)


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d, False)


def p6_words(spark: SparkSession, d: str) -> DataFrame:
    return languages.classify_words(table(spark, d, WORDS), "word_id", "ascii", "label")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    docs = languages.wrong_or_mixed(_languages(spark, d, True), "rec_id").select(F.lit(DOCS).alias("tab"), F.col("rec_id").alias("row_id"), "lang")
    words = p6_words(spark, d).where(F.col("right").isNotNull() & ~F.col("right").eqNullSafe(F.col("given")))
    return docs.unionByName(words.select(F.lit(WORDS).alias("tab"), F.col("word_id").alias("row_id"), F.col("right").alias("lang")))


def _records(spark: SparkSession, d: str) -> DataFrame:
    entries = copies.with_key(table(spark, d, "sanskrit_glossary"), "entry_id", ["sanskrit_term", "entry_json"], copies.canonical_entry, "sanskrit_glossary")
    names = copies.with_key(table(spark, d, "ayurveda_terms_from_ak"), "term_id", ["sanskrit_ayurvedic_terms"], copies.canonical_names, "ayurveda_terms_from_ak")
    return entries.unionByName(names)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.find_copies(_records(spark, d))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.count_records(_records(spark, d)).select("tab", "first_id", "n_copies")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "token_limits"), "limit_id", "capacity")


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_packed(spark, d), table(spark, d, "token_limits"), "limit_id", "capacity")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_personal(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "name_list")).drop("confidence")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact_personal(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "name_list"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_unified": p1_unified,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p5_found": p5_found,
    "p5_statistics": p5_statistics,
    "p6_found": p6_found,
    "p6_languages": p6_languages,
    "p6_words": p6_words,
    "p7_found": p7_found,
    "p7_records": p7_records,
    "p8_packed": p8_packed,
    "p8_usage": p8_usage,
    "p9_found": p9_found,
    "p9_passages": p9_passages,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

ORACLES: dict[str, str] = {
    "p2_found": sitelines.FOUND_SQL,
    "p2_clean": sitelines.CLEAN_SQL,
    "p7_found": copies.FOUND_SQL,
    "p7_records": copies.RECORDS_SQL,
}
