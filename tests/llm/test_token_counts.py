"""Operator 11 against the tokenizers library."""

import re

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorebase.llm import catalog
from lorebase.llm.token_counts import Vocabulary, count_symbols, counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "'s", "'LL", " ", "  ", "\n", "\x1c", "\x85", "é", "中", "٣", "՘", "࢏", "😀", " a", " 1", "..."])), max_size=12))
def test_counts_equal_the_library(library, vocabulary, parts):
    if not hasattr(vocabulary, "counter"):
        vocabulary.counter = counter(vocabulary, cache=50)
    text = "".join(parts)
    assert vocabulary.counter(text) == library(text)


def test_characters_newer_than_the_library(library, vocabulary):
    count = counter(vocabulary)
    for kind, ranges in vocabulary.newer.items():
        assert ranges, kind
        for point in [int(x, 16) for x in re.findall(r"U([0-9A-F]{8})", ranges)][:200]:
            text = f"a{chr(point)}1 {chr(point)}{chr(point)}b"
            assert count(text) == library(text)


def test_long_pieces(library, vocabulary):
    for text in ("a" * 100_000, "abcab" * 20_000, " " * 50_000 + "x", "é" * 30_000):
        assert counter(vocabulary)(text) == library(text)
    assert count_symbols(b"", vocabulary) == 0 and count_symbols(b"a", vocabulary) == 1


def test_odd_rows_and_columns(spark, library):
    rows = [(1, None), (2, ""), (None, "hello world"), (1, "<|endoftext|>"), (3, "x" * 3_000_000), (3, "x" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n_tokens", F.lit(1)).repartition(2)
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, PATH).collect()))
    assert got == sorted(((i or 0, len(t or ""), library(t or "")) for i, t in rows))
    assert token_counts(docs.where("false"), PATH).count() == 0


def test_whole_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = catalog.op11_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = library(texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)
