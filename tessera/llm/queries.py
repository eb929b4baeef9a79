"""One query an operator, over its whole table; where SQL can say the same, the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, jaccard, line_dedup, packing, passages, quality, toxicity, url_trust
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.filter_urls(table(spark, sf_dir, "pages"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.read_back(*chat.format_chats(rows))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), with_ids=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_url_filters, op4_chat_formatting, op5_byte_bpe, op6_substring_dedup, op7_toxicity, op8_nearest_neighbours, op9_jaccard_join, op10_best_fit_packing)}
SQL = {"op1_line_dedup": line_dedup.SQL, "op9_jaccard_join": jaccard.SQL}
