"""What the operators of this subpackage share: written cuts, word tables of text batches, hashes, connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: blank and tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_WORD_SEED = 0xD6E8FEB86659FD93
#: Words of more bytes are hashed one by one.
_LONG_WORD = 256
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode where none is set."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and lost executors cost no rerun of what is before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lorebase-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only where the counted rows are within the limit; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in this order."""
    return mix(mix(a + np.uint64(_STEP)) * np.uint64(_WORD_SEED) + b)


class Words:
    """The words of some consecutive texts: byte starts and ends, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data = data = _LOWER[data] if lower else data
        offsets = offsets - offsets[0]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        solid = ~_IS_SPACE[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        first[offsets[full]] = solid[offsets[full]]
        last[offsets[full + 1] - 1] = solid[offsets[full + 1] - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None
        self._levels: list[np.ndarray] = []

    @property
    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words: eight bytes a step, each step through the finaliser."""
        if self._hashes is None:
            lengths = self.ends - self.starts
            padded = np.zeros(len(self.data) + 8, np.uint8)
            padded[: len(self.data)] = self.data
            eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
            h = mix(lengths.astype(np.uint64) + np.uint64(_WORD_SEED))
            usual = lengths <= _LONG_WORD
            live, step = np.flatnonzero(usual), 0
            while len(live):
                left = lengths[live] - step
                x = eight[self.starts[live] + step] & _LOW_BYTES[np.minimum(left, 8)]
                h[live] = mix(h[live] * np.uint64(_STEP) + x)
                live, step = live[left > 8], step + 8
            for i in np.flatnonzero(~usual).tolist():
                h[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
            self._hashes = h
        return self._hashes

    def _runs(self, level: int) -> np.ndarray:
        """Hashes of the 2**level words from each word on, the halves mixed in their order."""
        while len(self._levels) <= level:
            if not self._levels:
                self._levels.append(self.hashes)
                continue
            half, width = self._levels[-1], 1 << (len(self._levels) - 1)
            self._levels.append(pair(half[: max(0, len(half) - width)], half[width:]))
        return self._levels[level]

    def spans(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences [i, j): of the longest power of two of words at each end, and their number."""
        n = j - i
        out = np.zeros(len(n), np.uint64)
        levels = np.frexp(n.astype(float))[1] - 1
        for level in np.unique(levels[n > 0]).tolist():
            k = np.flatnonzero((levels == level) & (n > 0))
            runs = self._runs(level)
            out[k] = mix(pair(runs[i[k]], runs[j[k] - (1 << level)]) + n[k].astype(np.uint64))
        return out

    def starts_of(self, k: int) -> np.ndarray:
        """Indices of the words at which k words of one text begin."""
        counts = np.diff(self.bounds)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(self.starts))
        return at[at + k <= self.bounds[1:][doc]]

    def texts(self, i: int, j: int) -> str:
        """Words [i, j) joined by one blank."""
        return self.joined(i, j).decode("utf-8", "replace")

    def joined(self, i: int, j: int) -> bytes:
        # bytes.split() parts at the very bytes of SPACES
        return b" ".join(self.data[self.starts[i] : self.ends[j - 1]].tobytes().split()) if j > i else b""


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, nulls as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def text_chunks(column: pa.Array, limit: int = 1 << 20, rows: int = 1 << 12) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of runs of whole texts of about limit bytes, of so many rows at most."""
    if not len(column):
        return
    data, offsets = string_buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, min(a + rows, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1]
        a = b


def word_chunks(column: pa.Array, lower: bool = False, limit: int = 1 << 20, rows: int = 1 << 12) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, offsets in text_chunks(column, limit, rows):
        yield a, b, Words(data, offsets, lower)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that come sorted by the keys, each with the places where its groups begin and its end."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        starts = _group_starts(t, keys)
        if len(starts) > 1:
            yield t.slice(0, int(starts[-1])).combine_chunks(), starts
        rest = t.slice(int(starts[-1]))
    if rest is not None and len(rest):
        yield rest.combine_chunks(), np.append(_group_starts(rest, keys), len(rest))


def _group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(t), bool)
    new[0] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def own_columns(docs: DataFrame, made: list[str]) -> list[str]:
    """The columns of docs but those named as what an operator makes: its columns take their place."""
    taken = {c.lower() for c in made}
    return [c for c in docs.columns if c.lower() not in taken]


def quoted(names: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges, by alternating large and small stars.

    Each round is a few aggregates and joins on the node, written to the shared folder; nothing is gathered
    per component. An empty edge table gives an empty result.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    seen = state(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        e = cut(
            met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "edges",
        )
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
