"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_tree, decontaminate, exact_dedup, hmm, language, mixing, near_dedup, pii, quality, url_filter


#: Rules as (host, start of the path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Hosts that are blocked, with their subdomains, where no rule fits: each name at each end.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_ENDS = ["example.com", "example.net", "example.org"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op5_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    nodes, turns = chat_tree.prefix_tree(_table(spark, sf_dir, "conversations").select(*added.columns).unionByName(added))
    return chat_tree.read_back(nodes, turns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, URL_RULES)
    hosts = url_filter.host_table(spark, [f"{name}.{end}" for end in LISTED_ENDS for name in LISTED_NAMES])
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), rules, hosts)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.lm_scores(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_language, op2_near_dedup, op3_quality, op4_pii, op5_chat_tree, op6_mixing, op7_exact_dedup, op8_url_filter, op9_decontaminate, op10_hmm)}


def oracle_sql() -> dict[str, str]:
    return {"op4_pii": pii.SQL, "op5_chat_tree": chat_tree.SQL, "op6_mixing": mixing.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_url_filter": url_filter.SQL}
