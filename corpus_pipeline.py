"""A corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

run(spark, sf_dir) applies the stages to ``documents``; each result is written as Parquet and read
again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, lang_id, mixing, ngram_join, shard
from lodestar.llm.common import Scratch, read, short_batches
from lodestar.llm.queries import language_model

#: Documents whose language is less certain than this are rejected, and those without letters.
LEAST_SCORE = 0.4


def _with_own_columns(docs: DataFrame, judge, *results: str) -> DataFrame:
    """judge(docs) with exactly the columns of docs, also where they have the names of judge's results."""
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in results}
    out = judge(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    model = language_model(spark, sf_dir)
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)
    return _with_own_columns(docs, lambda d: lang_id.identify(d, model).where(sure), "lang_pred", "score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return ngram_join.keep_one(docs, threshold="0.8", words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    benchmark = read(spark, sf_dir, "benchmark")
    return _with_own_columns(docs, lambda d: decontaminate.find_overlaps(d, benchmark).where("not contaminated"), "bench_items", "bench_equal", "contaminated")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard.shard(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]

#: SQL can express neither the trained model of the first stage nor the rounding of the fourth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
