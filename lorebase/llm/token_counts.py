"""Token counts by byte-pair merging with a heap over a linked list.

A text is parted at the vocabulary's added strings (one token each), the rest by the byte-level pattern into pieces.
A piece begins as one symbol a byte, in a linked list; a heap holds the adjacent pairs that have a merge, lowest rank
first, then the leftmost. Each pop joins two symbols, unless one of them has changed since, and pushes the pairs that
this makes. The count of a piece is its bytes minus its merges; no identifiers are emitted. A piece of n bytes costs
n log n, so texts without any blank are no danger. Counts of short pieces are kept in a cache of bounded size.

The vocabulary is a file of the `tokenizers` library (byte-level BPE, no normaliser) at a path that the driver reads;
its merges, at most MOST of them, go to every task. The letters and digits that part texts are those of that library:
where its Unicode tables lack a character that the `regex` module knows, the library's reading holds.

Null texts count as empty: 0 bytes, 0 tokens. Rows keep their id as it is, null and repeated ids too; each row is
counted alone. Bytes that are no UTF-8 count as U+FFFD. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import text_chunks

#: Merges of the largest vocabulary that is broadcast.
MOST = 1_000_000
#: Pieces kept with their counts in a task, and the length up to which they are.
CACHE, SHORT = 1 << 20, 64
#: Texts of more characters are parted piece by piece instead of as one list.
LONG = 1 << 20
#: The byte-level pattern of the vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def unknown_to_library(kind: str) -> str:
    """Characters of a class (L, N) that `regex` knows and the tokenizers library does not, as ranges of a character set."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    known = regex.compile(rf"\p{{{kind}}}")
    split = Split(Regex(rf"\p{{{kind}}}+"), "removed")
    new: list[int] = []
    for k in range(0, len(points), 4096):
        part = "".join(map(chr, points[k : k + 4096]))
        new += [ord(c) for piece, _ in split.pre_tokenize_str(part) for c in piece if known.match(c)]
    ranges: list[list[int]] = []
    for p in new:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)


class Vocabulary:
    """Merges by pair of symbols, the strings that are one token wherever they stand, and the pattern that parts the rest."""

    def __init__(self, path: str, most: int = MOST):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-pair models without normaliser and dropout")
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: only texts parted by the byte-level pattern without prefix space")
        if len(model["merges"]) > most:
            raise ValueError(f"{path}: {len(model['merges'])} merges, above {most}")
        added = [t["content"] for t in spec.get("added_tokens") or []]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or []):
            raise ValueError(f"{path}: added strings that take in what is around them")
        symbols = byte_symbols()
        self.first = [0] * 256
        number = {}
        for c, b in symbols.items():
            number[c] = self.first[b] = b
        #: (left << 32 | right) -> (rank, symbol); symbols are numbered by their string, since several merges can make one
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = number.setdefault(left + right, len(number))
            self.merges.setdefault(number[left] << 32 | number[right], (rank, made))
        self.added = "|".join(map(regex.escape, sorted(added, key=len, reverse=True)))
        self.newer = {k: unknown_to_library(k) for k in "LN"}


def count_symbols(piece: bytes, vocabulary: Vocabulary) -> int:
    """Symbols that are left of a piece when no adjacent pair has a merge any more."""
    n = len(piece)
    if n < 2:
        return n
    merges = vocabulary.merges
    symbol = [vocabulary.first[b] for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        m = merges.get(symbol[i] << 32 | symbol[i + 1])
        if m:
            heap.append((m[0], i, m[1]))
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i, made = heapq.heappop(heap)
        if symbol[i] < 0:
            continue
        j = after[i]
        if j >= n or merges.get(symbol[i] << 32 | symbol[j]) != (rank, made):
            continue  # one of the two has changed
        symbol[i], symbol[j] = made, -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            m = merges.get(made << 32 | symbol[k])
            if m:
                heapq.heappush(heap, (m[0], i, m[1]))
        h = before[i]
        if h >= 0:
            m = merges.get(symbol[h] << 32 | made)
            if m:
                heapq.heappush(heap, (m[0], h, m[1]))
    return left


def counter(vocabulary: Vocabulary, cache: int = CACHE) -> Callable[[str], int]:
    """A function from a text to its number of tokens."""
    newer = vocabulary.newer
    plain = regex.compile(PATTERN.replace("[^\\s{L}{N}]", "[^\\s\\p{L}\\p{N}]").replace("{L}", "\\p{L}").replace("{N}", "\\p{N}"))
    letter = {k: f"\\p{{{k}}}--[{x}]" if x else f"\\p{{{k}}}" for k, x in newer.items()}
    exact = regex.compile(PATTERN.replace("[^\\s{L}{N}]", f"(?:(?![{letter['L']}]|[{letter['N']}])\\S)").replace("{L}", f"[{letter['L']}]").replace("{N}", f"[{letter['N']}]"), regex.V1)
    odd = regex.compile(f"[{newer['L']}{newer['N']}]") if any(newer.values()) else None
    first = min((int(x[2:10], 16) for x in newer.values() if x), default=0)
    maybe = re.compile(f"[{chr(first)}-\U0010FFFF]")
    added = regex.compile(vocabulary.added) if vocabulary.added else None

    class Counts(dict):
        def __missing__(self, piece: str) -> int:
            n = count_symbols(piece.encode("utf-8"), vocabulary)
            if len(piece) <= SHORT:
                if len(self) >= cache:
                    self.clear()
                self[piece] = n
            return n

    counts = Counts().__getitem__

    def part(text: str) -> int:
        pattern = exact if odd and maybe.search(text) and odd.search(text) else plain
        return sum(map(counts, pattern.findall(text) if len(text) <= LONG else (m.group() for m in pattern.finditer(text))))

    def count(text: str) -> int:
        if not added or not added.search(text):
            return part(text)
        return sum(1 for _ in added.finditer(text)) + sum(map(part, added.split(text)))

    return count


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        if not hasattr(vocabulary, "counter"):
            vocabulary.counter = counter(vocabulary)  # its cache serves all tasks of this worker
        count = vocabulary.counter
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                raw, at = data.tobytes(), (offsets - offsets[0]).tolist()
                tokens = [count(raw[i:j].decode("utf-8", "replace")) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets).astype(np.int64)), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of docs under the vocabulary at a path of the driver; one pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_count(shared), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
