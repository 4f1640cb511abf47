"""Chunking of documents into paragraphs up to a token budget, as a fold in one expression per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions.text import estimate_tokens


def chunk_documents(documents: DataFrame, target: int = 600, min_chars: int = 30) -> DataFrame:
    """(doc_id, chunk_index, chunk_text, tokens): paragraphs (lines) roll into chunks of at most target tokens.

    A paragraph beyond the budget stands alone; chunks of fewer than min_chars characters are dropped.
    """
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    sized = F.transform(parts, lambda x: F.struct(x.alias("text"), estimate_tokens(x).alias("n")))
    chunk = "array<struct<text:string,n:bigint>>"
    start = F.struct(F.array().cast(chunk).alias("done"), F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n"))

    def add(s, x):
        full = (s["text"] != "") & (s["n"] + x["n"] > target)
        closed = F.when(full, F.concat(s["done"], F.array(F.struct(s["text"].alias("text"), s["n"].alias("n"))))).otherwise(s["done"])
        text = F.when(full | (s["text"] == ""), x["text"]).otherwise(F.concat(s["text"], F.lit("\n\n"), x["text"]))
        return F.struct(closed.alias("done"), text.alias("text"), F.when(full, x["n"]).otherwise(s["n"] + x["n"]).alias("n"))

    def close(s):
        return F.when(s["text"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["text"].alias("text"), s["n"].alias("n")))))

    chunks = F.filter(F.aggregate(sized, start, add, close), lambda c: F.length(c["text"]) >= min_chars)
    return documents.select("doc_id", F.posexplode(chunks).alias("chunk_index", "c")).select("doc_id", "chunk_index", F.col("c.text").alias("chunk_text"), F.col("c.n").alias("tokens"))
