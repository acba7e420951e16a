"""The queries opN_<name>: each operator over its whole table, with the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm import cws, mixing, orc_tokens, packing, pii, quality, quotes, simhash, substring, url_filter
from vireo.llm.common import scratch, table


#: Fixed value: the rules of the url filter, host suffix and path prefix.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "copies", "text_md5")


def op3_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(table(spark, sf_dir, "conversations"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-orc")
    orc_tokens.write_token_orc(table(spark, sf_dir, "documents"), path)
    return orc_tokens.digest(orc_tokens.read_token_orc(spark, path)).withColumnRenamed("id", "doc_id")


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compare_neighbours(table(spark, sf_dir, "documents")).drop("edited_text")


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda no: F.size(F.filter("p_base", lambda s: s["no"] == no)).cast("long")
    counts = [count(no).alias(f"n_{kind}") for no, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("p_base")), 256).alias("base_sha256"), pii.listed(F.col("p_spans")).alias("spans"))


def op8_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.line_first(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"q_{x}").alias(x) for x in names])


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_passages(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_pareto_mixing, op3_quotation_threads, op4_token_orc, op5_simhash_golay, op6_weighted_sampling,
        op7_boosted_pii, op8_line_first, op9_passage_dedup, op10_cost_packing,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_pareto_mixing": mixing.ORACLE_SQL, "op3_quotation_threads": quotes.ORACLE_SQL, "op8_line_first": quality.ORACLE_SQL, "op9_passage_dedup": substring.ORACLE_SQL}
