"""The streaming queries; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorebase.plans.catalog import ORACLES, QUERIES
from lorebase.sources.fixtures import derive, with_derivations
from lorebase.sources.shared import shared_folder
from lorebase.streaming import jobs


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def t1_stream_intake(spark: SparkSession, sf_dir: str):
    docs = jobs.read_files(spark, f"{sf_dir}/documents.parquet")
    arrivals = docs.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("research_id"), F.col("source").alias("research_type"))
    existing = derive(spark, sf_dir, "fx_raw_files").where("triage_decision = 'commit'")
    return jobs.intake(arrivals, existing, _folder(spark))


def t2_stream_fact_signals(spark: SparkSession, sf_dir: str):
    facts = derive(spark, sf_dir, "fx_facts")
    arriving = shared_folder(spark, "arriving")
    facts.where("valid_from >= DATE '2000-01-01'").repartition(12, "id").write.parquet(arriving)
    return jobs.fact_signals(jobs.read_files(spark, arriving + "/"), facts, _folder(spark))


def t3_stream_usage(spark: SparkSession, sf_dir: str):
    e = jobs.read_files(spark, f"{sf_dir}/events.parquet")
    source = F.when(F.col("event_type") == "view", "embedding").when(F.col("event_type") == "click", "agent_runtime").otherwise(F.col("event_type"))
    usage = e.select(F.col("ts").cast("timestamp").alias("create_time"), source.alias("source"), F.floor(F.col("value") * 10).alias("tokens_in"), F.floor("value").alias("tokens_out"))
    return jobs.usage_daily(usage, _folder(spark))


def t4_stream_candidates(spark: SparkSession, sf_dir: str):
    e = jobs.read_files(spark, f"{sf_dir}/events.parquet")
    kind = F.when(F.col("user_id") % 7 == 0, "unknown-").when(F.col("user_id") % 7 == 1, "major-").otherwise("firm-")
    mentions = e.select(F.concat(F.lit("companies/"), kind, F.col("user_id").cast("string")).alias("slug"), (6000001 + F.col("event_id") % 997).alias("source_page_id"), F.col("event_type").alias("alias"))
    old = derive(spark, sf_dir, "fx_mentions").groupBy("slug").agg(F.min("source_page_id").alias("low")).where("low % 2 = 0")
    pool = old.select("slug", F.lit("merged").alias("status"), F.array(F.lit("x")).alias("aliases"), F.array(F.lit(1).cast("long")).alias("source_page_ids"))
    return jobs.candidates(mentions, _folder(spark), pool).select("slug", "status", "evidence_count")


QUERIES |= {"t1_stream_intake": t1_stream_intake, "t2_stream_fact_signals": t2_stream_fact_signals, "t3_stream_usage": t3_stream_usage, "t4_stream_candidates": t4_stream_candidates}
ORACLES |= {
    "t1_stream_intake": with_derivations("SELECT research_id, research_type FROM fx_raw_files WHERE triage_decision <> 'commit'"),
    "t2_stream_fact_signals": ORACLES["f13_detect_fact_signals"],
    "t3_stream_usage": ORACLES["q18_usage_daily"],
    "t4_stream_candidates": ORACLES["e17_candidate_pool"],
}
