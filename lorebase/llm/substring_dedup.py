"""Substring dedup with repeated-phrase automata.

A window is `window` consecutive words of one text. A word goes when a window that covers it starts anywhere else
too. The steps, all Spark jobs:

1. Anchors. Every window has one anchor: the smallest of its 16-word hashes (leftmost of equals), which depends on
   the window's words alone. The windows of a text with the same anchor form one passage of 35 to 54 words.
   Only anchors that occur at least twice can hold a repeated window; the others end here, after a count. Equal
   passages (same anchor, same 64-bit hash of all words) are settled once, with their number.
   A passage with a great share of all occurrences is dealt in parts when the findings go back.
2. Confirm. Different passages are dealt by anchor. A task takes whole anchor groups, some thousand passages at a
   time, numbers their words exactly and counts the windows as word sequences.
3. Automata. Of each such shard the recurring passages are compiled into an Aho-Corasick automaton (pyahocorasick,
   one character a word), through which all passages of the shard are streamed; every occurrence is located.
4. The located spans go back to all documents that hold the passages, overlaps merged.

An anchor with very many different passages (above `hot`) would crowd one task; its windows are counted by a join on
their words instead, with the same result. Nothing is dropped.

Null or blank texts have no words. Null and repeated ids: each row is handled alone. Columns of docs with the name of
one of the four made here are replaced; all others pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lorebase.llm.common import Words, cut, own_columns, quoted, word_chunks

WINDOW = 35
#: Words hashed for an anchor.
GRAM = 16
#: Different passages of an anchor above which its windows are counted by a join.
HOT = 20_000
#: Passages that share one automaton, besides the last whole anchor group.
SHARD = 4000
#: Passages with more than this share of all occurrences are dealt in parts (so there are fewer than 1 / SHARE).
SHARE = 1 / 500
MADE = ("__n_words", "__n_removed", "__kept_sha256", "__kept_text")


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the minimum of x[i : i + width], the first of equals."""
    place = np.arange(len(x))
    have, m = 1, place

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    while have * 2 <= width:
        m = lower(m[: len(m) - have], m[have:])
        have *= 2
    return lower(m[: len(x) - width + 1], m[width - have :]) if have < width else m


def _passages(w: Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, first word in it, words, anchor hash, hash of all words) of the passages of a chunk."""
    none = np.zeros(0, np.int64)
    starts = w.starts_of(window)
    gram = min(GRAM, window)
    if not len(starts):
        return none, none, none, none, none
    at = np.arange(len(w.starts) - gram + 1)
    grams = w.spans(at, at + gram)
    anchor = _lowest(grams, window - gram + 1)[starts]
    text = np.searchsorted(w.bounds, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    whole = w.spans(starts[first], starts[last] + window).astype(np.int64)
    return text[first], starts[first] - w.bounds[text[first]], starts[last] - starts[first] + window, grams[anchor[first]].astype(np.int64), whole


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, w in word_chunks(batch.column(1)):
                text, first, n, anchor, digest = _passages(w, window)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a + text]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(digest)], ["key", "first", "n", "anchor", "digest"])

    return run


def _cut_out():
    """Texts of the marked passages, from rows (text, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, marks = batch.columns
            at = marks.offsets.to_numpy()
            flat = marks.flatten()
            first, n = (flat.field(i).to_numpy() for i in range(2))
            for a, b, w in word_chunks(body):
                which, texts = [], []
                for row in range(a, b):
                    base, end = int(w.bounds[row - a]), int(w.bounds[row - a + 1])
                    for k in range(at[row], at[row + 1]):
                        i = base + int(first[k])
                        if i + int(n[k]) <= end:  # else of another row with the same key
                            which.append(k)
                            texts.append(w.texts(i, i + int(n[k])))
                if which:
                    own = flat.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([own.field(2), own.field(3), own.field(4), pa.array(texts, pa.string())], ["anchor", "digest", "m", "passage"])

    return run


def _pieces(recurs: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal runs of words that the windows starting at these places cover."""
    runs: list[tuple[int, int]] = []
    for s in recurs:
        if runs and s <= runs[-1][1]:
            runs[-1] = (runs[-1][0], s + window)
        else:
            runs.append((s, s + window))
    return runs


def locate(passages: list[str], groups: list[int], counts: list[int], window: int) -> list[list[int]]:
    """For each passage of a shard the flat (start, end, ...) word spans in which recurring phrases occur.

    Windows are counted within their group (one anchor); the recurring phrases of all groups make the automaton.
    """
    number: dict[str, int] = {}
    coded = []
    for p in passages:
        ids = [number.setdefault(x, len(number)) for x in p.split(" ")]
        coded.append("".join([chr(i + 1 if i < 0xD7FF else i + 0x801) for i in ids]))
    seen: Counter = Counter()
    for text, group, n in zip(coded, groups, counts, strict=True):
        for s in range(len(text) - window + 1):
            seen[group, text[s : s + window]] += n
    automaton = ahocorasick.Automaton()
    for text, group in zip(coded, groups, strict=True):
        for s, e in _pieces([s for s in range(len(text) - window + 1) if seen[group, text[s : s + window]] > 1], window):
            automaton.add_word(text[s:e], e - s)
    if not len(automaton):
        return [[] for _ in coded]
    automaton.make_automaton()
    out = []
    for text in coded:
        spans: list[int] = []
        for end, n in sorted((end + 1, n) for end, n in automaton.iter(text)):
            s = end - n
            while spans and s <= spans[-1]:
                s = min(s, spans[-2])
                del spans[-2:]
            spans += [s, end]
        out.append(spans)
    return out


def _confirm(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shard(part: pd.DataFrame) -> pd.DataFrame:
            spans = locate(part["passage"].tolist(), part["anchor"].tolist(), part["m"].tolist(), window)
            out = pd.DataFrame({"anchor": part["anchor"], "digest": part["digest"], "spans": spans})
            return out[[len(s) > 0 for s in spans]]

        rest = None
        for f in frames:
            rest = f if rest is None else pd.concat([rest, f], ignore_index=True)
            while len(rest) > SHARD:
                anchors = rest["anchor"].to_numpy()
                change = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
                ends = change[change >= SHARD]
                if not len(ends):
                    break
                yield shard(rest.iloc[: ends[0]])
                rest = rest.iloc[ends[0] :]
        if rest is not None and len(rest):
            yield shard(rest)

    return run


def _crowded(passages: DataFrame, window: int) -> DataFrame:
    """The same by joins, for anchors with very many different passages: every window is a row, counted by its words."""
    words = F.split("passage", " ")
    one = passages.withColumn("w", words).select("anchor", "digest", "m", F.posexplode(F.expr(f"transform(sequence(1, size(w) - {window} + 1), i -> array_join(slice(w, i, {window}), ' '))")).alias("s", "phrase"))
    again = one.groupBy("phrase").agg(F.sum("m").alias("times")).where("times > 1").select("phrase")
    return one.join(again, "phrase").groupBy("anchor", "digest").agg(F.flatten(F.collect_list(F.array("s", F.col("s") + window))).alias("spans"))


def _apply(place: int):
    """The rows (a struct, with the text at a place) with word counts, the digest of the kept words joined by blanks, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks = batch.columns
            for a, b, w in word_chunks(rows.field(place).cast(pa.string())):
                words = np.diff(w.bounds)
                removed = np.zeros(b - a, np.int64)
                kept: list = [None] * (b - a)
                digests = []
                for row in range(b - a):
                    i, j = int(w.bounds[row]), int(w.bounds[row + 1])
                    raw = w.joined(i, j)
                    if marks[a + row].is_valid:
                        keep = np.ones(j - i, bool)
                        for s, e in marks[a + row].as_py():
                            keep[s:e] = False
                        raw = b" ".join(itertools.compress(raw.split(), keep.tolist()))
                        removed[row] = j - i - int(keep.sum())
                    if removed[row]:
                        kept[row] = raw.decode("utf-8", "replace")
                    digests.append(hashlib.sha256(raw).hexdigest())
                made = [pa.array(words.astype(np.int64)), pa.array(removed), pa.array(digests), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), *made], ["row", *MADE])

    return run


def drop_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with __n_words, __n_removed, __kept_sha256 and __kept_text (null: nothing was removed).

    Rows are told apart by a hash of id and text; rows equal in both are occurrences of the same words and share
    what is found.
    """
    own = own_columns(docs, MADE)
    place = [c.lower() for c in own].index(text_col.lower())
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.col(id_col), text)
    anchors = cut(docs.select(key.alias("key"), text.alias("text")).mapInArrow(_anchors(window), "key long, first int, n int, anchor long, digest long"), "anchors")
    recurring = cut(anchors.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "recurring")
    # a plain join and a write: Spark splits an anchor with a great share of the rows
    occurrences = cut(anchors.join(recurring, "anchor"), "occurrences")
    # equal passages are settled once, on one of them
    distinct = cut(occurrences.groupBy("anchor", "digest").agg(F.count("*").alias("m"), F.min(F.struct("key", "first", "n")).alias("x")), "passages")
    marks = distinct.groupBy(F.col("x.key").alias("key")).agg(F.collect_list(F.struct("x.first", "x.n", "anchor", "digest", "m")).alias("marks"))
    # of rows equal in id and text one is enough to read the passages from
    texts = docs.select(key.alias("key"), text.alias("text"))
    repeated = cut(occurrences.groupBy("key", "first").agg(F.count("*").alias("times")).where("times > 1").select("key").distinct(), "repeated")
    if not repeated.isEmpty():
        texts = texts.join(repeated, "key", "left_anti").unionByName(texts.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    passages = texts.join(marks, "key").select("text", "marks").mapInArrow(_cut_out(), "anchor long, digest long, m long, passage string")
    schema = "anchor long, digest long, spans array<int>"
    crowded = cut(distinct.groupBy("anchor").agg(F.count("*").alias("d")).where(F.col("d") > hot).select("anchor"), "crowded")
    if crowded.isEmpty():
        located = passages.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_confirm(window), schema)
    else:
        usual = passages.join(crowded, "anchor", "left_anti")
        located = usual.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_confirm(window), schema)
        located = located.unionByName(_crowded(passages.join(crowded, "anchor", "left_semi"), window))
    total = distinct.agg(F.sum("m")).first()[0] or 0
    # fewer than 1 / SHARE rows, whatever the input
    often = F.broadcast(distinct.where(F.col("m") > SHARE * total).select("anchor", "digest", F.ceil(F.col("m") / F.lit(max(1.0, SHARE * total))).cast("int").alias("parts")))
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.array(F.col("first") + F.get("spans", i), F.col("first") + F.get("spans", i + 1)))
    found = (
        occurrences.select("key", "first", "anchor", "digest").join(often, ["anchor", "digest"], "left")
        .withColumn("part", F.expr("cast(coalesce(pmod(xxhash64(key, first), parts), 0) as int)")).drop("parts")
        .join(located.join(often, ["anchor", "digest"], "left").withColumn("part", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts"), ["anchor", "digest", "part"])
        .select("key", F.explode(pairs).alias("x"))
        .groupBy("key")
        .agg(F.collect_set("x").alias("spans"))
    )
    rows = docs.select(F.struct(*quoted(own)).alias("row"), key.alias("key")).join(found, "key", "left").select("row", "spans")
    made = [StructField(MADE[0], LongType()), StructField(MADE[1], LongType()), StructField(MADE[2], StringType()), StructField(MADE[3], StringType())]
    return rows.mapInArrow(_apply(place), StructType([StructField("row", rows.schema["row"].dataType), *made])).select("row.*", *MADE)
