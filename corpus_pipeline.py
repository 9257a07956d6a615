"""From raw documents to a training mix: quality, exact copies, near copies, benchmark leaks, mixing."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import drop_written, materialize, written
from tidemark.llm.decontaminate import drop_leaks
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import drop_near
from tidemark.llm.quality import keep_good


#: The tables that the stage called last wrote for its result.
_SCRATCH: list[str] = []


def _stage(step):
    """A stage begins when the result of the one before it is written, so what that one wrote on the way goes."""

    @wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_written(spark, _SCRATCH)
        before = set(written())
        out = step(spark, docs, sf_dir)
        _SCRATCH[:] = [path for path in written() if path not in before]
        return out

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return drop_copies(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one stays."""
    return drop_near(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that is left with the words taken of it and its training position."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "position")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("mixing", mixing)]
#: A classifier and near duplicates are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
