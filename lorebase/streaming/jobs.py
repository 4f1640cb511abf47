"""Structured Streaming forms of batch jobs.

A job writes one folder per micro-batch, or merges a micro-batch into a keyed table under its number; either way a
replay changes nothing. A stream in which nothing has arrived gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorebase.sources.keyed import KeyedTable


def run_batches(stream: DataFrame, out: str, sink: Callable[[DataFrame, int], None]) -> list[dict]:
    """Process what is there now, batch by batch; the progress reports of the run."""
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q.recentProgress


def run_available(stream: DataFrame, out: str, each: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Process what is there now; each(batch, epoch) is written to out/batch=epoch. Returns all batches with their number."""
    spark = stream.sparkSession
    run_batches(stream, out, lambda batch, epoch: each(batch, epoch).write.mode("overwrite").parquet(f"{out}/data/batch={epoch}"))
    try:
        return spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data/batch=*")
    except AnalysisException:  # no batch ran
        return each(spark.createDataFrame([], stream.schema), -1).withColumn("batch", F.lit(-1)).where("false")


def read_files(spark: SparkSession, path: str, schema: StructType | str | None = None, files: int = 8) -> DataFrame:
    """A stream of the Parquet files at path, so many a batch, with the schema given or else the one they have now."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")


def usage_daily(usage: DataFrame, out: str, utc_offset_hours: int = 8) -> DataFrame:
    """Sums per local day and source of a stream (create_time, source, tokens_in, tokens_out), however late rows come: each batch writes its part."""
    day = F.window("create_time", "1 day", startTime=f"{(24 - utc_offset_hours) % 24} hours")

    def each(batch: DataFrame, epoch: int) -> DataFrame:
        sums = batch.groupBy(day.alias("w"), "source").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("requests"))
        return sums.select((F.col("w.start") + F.expr(f"INTERVAL {utc_offset_hours} HOURS")).cast("date").alias("day"), "source", "tokens_in", "tokens_out", "requests")

    parts = run_available(usage, out, each)
    return parts.groupBy("day", "source").agg(*[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "requests")])


def intake(arrivals: DataFrame, existing: DataFrame, out: str, delay: str = "10 minutes", buckets: int = 64) -> DataFrame:
    """Register arriving (research_id, research_type) once each: not in the table, nor in an earlier batch.

    Repeats that arrive within the delay are dropped in the stream, whose state forgets ids after it: the time is that
    of arrival, so no row is ever too late. Repeats that come later are found in a keyed registry, of which a batch
    reads and rewrites the buckets its ids fall into. Of two rows with one id the one registered first counts.
    """
    registry = KeyedTable(arrivals.sparkSession, f"{out}/registry", "research_id string, research_type string, batch long", ["research_id"], buckets)
    known = existing.select("research_id", F.lit(None).cast("string").alias("research_type"), F.lit(-1).cast("long").alias("batch"))
    registry.upsert(known, ["research_id"], replace=False, commit="existing")

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("research_id", "research_type", F.lit(epoch).cast("long").alias("batch"))
        registry.upsert(rows, ["research_type"], replace=False, commit=f"batch-{epoch}")

    timed = arrivals.select("research_id", "research_type", F.current_timestamp().alias("seen")).withWatermark("seen", delay)
    intake.progress = run_batches(timed.dropDuplicatesWithinWatermark(["research_id"]), out, sink)  # the last run's, for monitoring
    return registry.read().where("batch >= 0").select("research_id", "research_type")


def fact_signals(new_facts: DataFrame, history: DataFrame, out: str) -> DataFrame:
    """Signals of a stream of new facts against the history table, keyed by the fact: a replayed batch overwrites itself."""
    from lorebase.operators.facts import detect_fact_signals

    return run_available(new_facts, out, lambda batch, _: detect_fact_signals(history, batch)).drop("batch").dropDuplicates(["fact_id"])


def candidates(mentions: DataFrame, out: str, pool: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """The candidate pool after a stream of (slug, source_page_id, alias), as batch mentions would make it, whatever the batches.

    The pool is a keyed table: a batch unites its aliases and sources with those of its slugs and leaves a status that
    was decided; it rewrites the buckets of these slugs only.
    """
    from lorebase.operators.entities import merge_candidate_pool

    schema = "slug string, status string, aliases array<string>, source_page_ids array<long>, evidence_count int"
    table = KeyedTable(mentions.sparkSession, f"{out}/pool", schema, ["slug"], buckets)
    if pool is not None:
        table.upsert(pool.withColumn("evidence_count", F.size("source_page_ids")), ["slug"], replace=False, commit="pool")
    run_batches(mentions, out, lambda batch, epoch: table.apply(batch, merge_candidate_pool, f"batch-{epoch}") and None)
    return table.read()
