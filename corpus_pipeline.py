"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
rereads it for the next stage. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import decontamination, language_id, mixing, near_duplicates, substring_dedup
from lorebase.llm.common import cut, fold, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or none learned) go; the others get the predicted lang where theirs is null."""
    model = language_id.train(docs.where(fold("doc_id", 3) != 1))
    known = language_id.identify(docs, model).where(F.col("__lang_pred") != language_id.UNKNOWN)
    return known.select(*[F.coalesce("lang", "__lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    return near_duplicates.keep_first(docs, percent=85)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by repeated 35-word windows go; a document that loses all its words goes too."""
    done = substring_dedup.drop_repeats(docs, window=35)
    text = F.coalesce("__kept_text", "text")
    kept = done.where((F.col("__n_words") == 0) | (F.col("__n_removed") < F.col("__n_words")))
    changed = {"text": text, "n_chars": F.when(F.col("__kept_text").isNull(), F.col("n_chars")).otherwise(F.length("__kept_text"))}
    return kept.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents with a copy at least, and how many copies the mix takes."""
    mixed = mixing.mix_sources(docs)
    return mixed.where("__copies > 0").select(*docs.columns, F.col("__size").alias("size"), F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("decontaminate", decontaminate),
    ("mix_sources", mix),
]

#: Newton's iterations and components over links are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
