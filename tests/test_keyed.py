"""Stored keyed tables: retries, interrupted merges, untouched buckets; and the streams over them."""

import random

import pytest
from pyspark.sql import functions as F

from lorebase.operators.entities import merge_candidate_pool
from lorebase.sources.keyed import KeyedTable
from lorebase.streaming import jobs

SCHEMA = "a string, b long, v long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges_touch_their_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["a", "b"], buckets=8)
    assert rows(t.read()) == []
    first = [("x", i, i) for i in range(50)] + [(None, None, 1), (None, 1, 2)]
    assert t.upsert(spark.createDataFrame(first, SCHEMA), ["v"], replace=False, commit="1") == 8
    assert rows(t.read()) == sorted(first, key=str)
    assert t.upsert(spark.createDataFrame([(None, None, 9), ("x", 3, 9)], SCHEMA), ["v"], replace=False, commit="2") == 0  # keys are there
    more = spark.createDataFrame([(None, None, 9), ("x", 3, 3), ("y", 1, 5), ("y", 1, 4)], SCHEMA)
    assert t.upsert(more, ["v"], replace=True, commit="3") == 2  # x, 3 is there as it is
    want = sorted([r for r in first if r[:2] != (None, None)] + [(None, None, 9), ("y", 1, 4)], key=str)
    assert rows(t.read()) == want
    assert t.upsert(more, ["v"], replace=True, commit="3") == 0 and t.upsert(more, ["v"], replace=True, commit="4") == 0
    assert rows(t.read()) == want and rows(KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["a", "b"], buckets=8).read()) == want


def test_an_update_that_is_there_hides_later_ones_of_its_key(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["a", "b"], buckets=4)
    more = spark.createDataFrame([("y", 1, 5), ("y", 1, 4)], SCHEMA)
    for commit in ("1", "2", "3"):
        assert t.upsert(more, ["v"], replace=True, commit=commit) == int(commit == "1")
        assert rows(t.read()) == [("y", 1, 4)]


def test_an_interrupted_merge_shows_nothing_and_is_repeated(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["a"], buckets=4)
    t.upsert(spark.createDataFrame([("x", 1, 1)], SCHEMA), ["v"], replace=True, commit="1")
    new = spark.createDataFrame([("x", 2, 2), ("y", 1, 1)], SCHEMA)
    keep, calls = KeyedTable._manifest, []

    def fail(self):  # the second look is the one before the manifest is written
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return keep(self)

    monkeypatch.setattr(KeyedTable, "_manifest", fail)
    with pytest.raises(RuntimeError):
        t.upsert(new, ["v"], replace=True, commit="2")
    monkeypatch.setattr(KeyedTable, "_manifest", keep)
    assert rows(t.read()) == [("x", 1, 1)]
    assert t.upsert(new, ["v"], replace=True, commit="2") > 0 and rows(t.read()) == [("x", 2, 2), ("y", 1, 1)]
    assert t.apply(spark.createDataFrame([("x",)], "a string"), lambda old, gone: old.join(gone, "a", "left_anti"), "3") == 1
    assert rows(t.read()) == [("y", 1, 1)]


@pytest.mark.parametrize("files", [1, 5])
def test_candidates_equal_their_batch_form_after_any_split(spark, tmp_path, files):
    rng = random.Random(files)
    mentions = [(f"companies/{rng.choice(['unknown-', 'firm-', 'major-'])}{rng.randint(1, 12)}", rng.randint(1, 30), rng.choice(["A", "b", "c"])) for _ in range(150)]
    schema = "slug string, source_page_id long, alias string"
    path = str(tmp_path / "mentions.parquet")
    spark.createDataFrame(mentions, schema).repartition(5).write.parquet(path)
    pool = spark.createDataFrame([("companies/firm-1", "promoted", ["z"], [99]), ("companies/old", "merged", [], [1])], "slug string, status string, aliases array<string>, source_page_ids array<long>")
    got = jobs.candidates(jobs.read_files(spark, path, files=files), str(tmp_path / "out"), pool, buckets=8)
    assert rows(got) == rows(merge_candidate_pool(pool, spark.createDataFrame(mentions, schema)))
    again = jobs.candidates(jobs.read_files(spark, path, files=files), str(tmp_path / "out"), pool, buckets=8)  # nothing new
    assert rows(again) == rows(got)


def test_intake_forgets_in_the_stream_and_remembers_in_the_registry(spark, tmp_path):
    path, schema = tmp_path / "arrivals.parquet", "research_id string, research_type string"
    batches = 12
    for k in range(batches):  # every file repeats ids of the first and of the one before
        ids = [*range(40 * k, 40 * k + 40), *range(max(0, 40 * k - 5), 40 * k), 0, 1]
        spark.createDataFrame([(f"r{i}", "report") for i in ids] + [(f"r{40 * k}", "report"), ("known", "report")], schema).coalesce(1).write.mode("append").parquet(str(path))
    existing = spark.createDataFrame([("known", "x")], schema)
    stream = jobs.read_files(spark, str(path), files=1)
    got = jobs.intake(stream, existing, str(tmp_path / "out"), delay="0 seconds", buckets=8)
    assert rows(got) == sorted(((f"r{i}", "report") for i in range(40 * batches)), key=str)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in jobs.intake.progress if p["stateOperators"]]
    assert len(held) >= batches and max(held) <= 120  # of some batches, not of all 480 ids
    assert rows(jobs.intake(stream, existing, str(tmp_path / "out"), delay="0 seconds", buckets=8)) == rows(got)


def test_streams_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    usage = jobs.read_files(spark, str(tmp_path / "none") + "/", "create_time timestamp, source string, tokens_in long, tokens_out long")
    assert jobs.usage_daily(usage, str(tmp_path / "u")).columns == ["day", "source", "tokens_in", "tokens_out", "requests"]
    mentions = jobs.read_files(spark, str(tmp_path / "none") + "/", "slug string, source_page_id long, alias string")
    assert rows(jobs.candidates(mentions, str(tmp_path / "c"))) == []
    arrivals = jobs.read_files(spark, str(tmp_path / "none") + "/", "research_id string, research_type string")
    assert rows(jobs.intake(arrivals, spark.createDataFrame([("k", "x")], "research_id string, research_type string"), str(tmp_path / "i"))) == []
    assert jobs.run_available(arrivals.select(F.col("research_id")), str(tmp_path / "r"), lambda b, _: b).count() == 0
