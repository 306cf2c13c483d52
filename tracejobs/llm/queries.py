"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracejobs.llm import conversation_repair, embed_dedup, exact_dedup, filter_audit, html_extract, license_scan, lm_score, mixing, ngram_join, packing, topk_search, toxicity, warc
from tracejobs.llm.common import small, store, tables


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(tables(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(tables(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tables(spark, sf_dir, "documents"))


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(tables(spark, sf_dir, "documents"), remember=800_000)


def op5_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(tables(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/language; in each directory the document that comes first of those with
    ``Licen`` in their first line is its licence file."""
    docs = tables(spark, sf_dir, "documents")
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    docs = docs.select("doc_id", "text", folder.alias("folder"))
    heads = docs.where(F.substring_index("text", "\n", 1).contains("icense")).groupBy("folder").agg(F.min("doc_id").alias("head"))
    files = docs.join(small(store(heads, "heads")[0], 100_000), "folder", "left")
    name = F.when(F.col("doc_id") == F.col("head"), "LICENSE").otherwise(F.concat(F.lit("doc-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    files = files.select("doc_id", F.concat_ws("/", "folder", name).alias("path"), "text")
    return license_scan.license_scan(files).drop("similarity")


def op7_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(tables(spark, sf_dir, "pages"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embed_dedup(tables(spark, sf_dir, "embeddings"))


def op9_warc_chunked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(tables(spark, sf_dir, "pages"))


def op10_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(tables(spark, sf_dir, "embeddings")).drop("query_row")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.conversation_repair(tables(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_cost_balanced_packing": op2_cost_balanced_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_context_mixing_lm": op5_context_mixing_lm,
    "op6_license_scan": op6_license_scan,
    "op7_page_differencing": op7_page_differencing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_warc_chunked_table": op9_warc_chunked_table,
    "op10_toxicity_kneser_ney": op10_toxicity_kneser_ney,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_license_scan": license_scan.ORACLE_SQL,
    "op8_embedding_near_dedup": embed_dedup.ORACLE_SQL,
    "op9_warc_chunked_table": warc.ORACLE_SQL,
    "op11_exact_top_k": topk_search.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
