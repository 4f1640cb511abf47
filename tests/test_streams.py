"""Streams whose rows come late and in many micro-batches."""

import datetime
import random

from pyspark.sql import functions as F

from lorebase.streaming import jobs


def test_usage_counts_rows_of_old_days_in_later_batches(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(start + datetime.timedelta(hours=7 * i), "ab"[i % 2], i, 1) for i in range(400)]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "usage.parquet")
    spark.createDataFrame(rows, "create_time timestamp, source string, tokens_in long, tokens_out long").repartition(20).write.parquet(path)
    got = jobs.usage_daily(jobs.read_files(spark, path), str(tmp_path / "out")).collect()
    day = (F.col("create_time") + F.expr("INTERVAL 8 HOURS")).cast("date")
    want = spark.read.parquet(path).groupBy(day.alias("day"), "source").agg(F.sum("tokens_in"), F.sum("tokens_out"), F.count("*")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r["requests"] for r in got) == 400
