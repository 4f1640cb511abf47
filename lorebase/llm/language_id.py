"""Language identification with error-correcting output codes.

Each language gets a codeword of +1 and -1. For every bit a binary classifier over hashed byte n-grams (two
and three bytes) tells the languages whose bit is +1 from the others; its margin for a text is the mean log odds of the
text's n-grams. Decoding is loss-weighted: the codeword with the smallest exponential loss over the bits wins, and a
text whose two best codewords lie close together is flagged as ambiguous. A prediction depends on the text alone:
n-grams end with blanks at the end of a text.

The n-gram counts come from every training row, are summed per task, then per language and n-gram over the cluster.
The driver reads them for LANGUAGES_AT_ONCE languages at a time and keeps two sums a bit and bucket, so its memory
does not grow with the number of languages or of texts.

Texts that are null or have no letter get `und` and score 0; so does everything if there is nothing to learn from.
Rows with a null language are predicted but teach nothing. Repeated rows count as often as they occur. Extra
columns are passed through by `identify`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from lorebase.llm.common import cut, own_columns, quoted, text_chunks

BUCKETS = 1 << 16
#: Languages whose counts a task, or the driver, holds at a time.
LANGUAGES_AT_ONCE = 256
UNKNOWN = "und"
MADE = ("__lang_pred", "__lang_score", "__ambiguous")
#: Letters in lower case, everything else that is ASCII as a blank; bytes above 127 stay.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_CHUNK = 1 << 18


def _ngrams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the bigram and of the trigram that starts at each byte; blanks beyond the ends of the texts."""
    b = _FOLD[data]
    if len(b) > 1:  # capital letters of the Latin-1 block
        upper = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[:-1] == 0xC3)
        b[1:][upper] += 32
    x = np.full(len(b) + 2, 32, np.uint32)
    x[: len(b)] = b
    second, third = x[1:-1].copy(), x[2:].copy()
    last = ends[ends > 0] - 1
    second[last] = third[last] = 32
    third[np.maximum(last - 1, 0)] = 32
    two = x[:-2] * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77)
    three = two + third * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    two ^= two >> np.uint32(15)
    two *= np.uint32(0x2C1B3C6D)
    three ^= three >> np.uint32(15)
    three *= np.uint32(0x2C1B3C6D)
    return two >> np.uint32(16), three >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of each language among the rows (text, lang) of a task; a language may come in several parts."""
    totals: dict[str, np.ndarray] = {}

    def handed_up() -> Iterator[pa.RecordBatch]:
        for x, counts in totals.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(counts[full])], ["lang", "bucket", "n"])
        totals.clear()

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for a, b, data, offsets in text_chunks(batch.column(0), _CHUNK):
            at = offsets - offsets[0]
            two, three = _ngrams(data, at[1:])
            own = langs[a:b]
            kinds = {x: k for k, x in enumerate(dict.fromkeys(own))}
            owner = np.repeat([kinds[x] for x in own], np.diff(at))
            for x, k in kinds.items():
                if x not in totals:
                    if len(totals) >= LANGUAGES_AT_ONCE:
                        yield from handed_up()
                    totals[x] = np.zeros(BUCKETS, np.int64)
                mine = owner == k if len(kinds) > 1 else slice(None)
                totals[x] += np.bincount(two[mine], minlength=BUCKETS) + np.bincount(three[mine], minlength=BUCKETS)
    yield from handed_up()


def codewords(languages: int, bits: int = 0) -> np.ndarray:
    """One row of +1 and -1 a language, far apart; the same for the same number of languages."""
    bits = bits or 15 + 3 * max(languages - 1, 1).bit_length()
    best, far = None, -1
    rng = np.random.default_rng(languages)
    # many languages are told apart by their longer codewords: one draw is enough
    for _ in range(60 if languages <= LANGUAGES_AT_ONCE else 1):
        code = np.where(rng.random((languages, bits)) < 0.5, -1, 1)
        constant = np.abs(code.sum(axis=0)) == languages
        code[rng.integers(0, max(languages, 1), bits)[constant], np.flatnonzero(constant)] *= -1
        while len(np.unique(code, axis=0)) < languages:
            code = np.where(rng.random((languages, bits)) < 0.5, -1, 1)
        if languages > LANGUAGES_AT_ONCE:
            return code
        apart = (bits - code @ code.T) // 2 + np.eye(languages, dtype=int) * bits
        if apart.min() > far:
            best, far = code, apart.min()
    return best


class Model:
    """A weight for every bit and bucket, from blocks of languages with their counts (languages x BUCKETS)."""

    def __init__(self, languages: list[str], blocks: Iterator[np.ndarray], smoothing: float = 0.5):
        self.languages = languages
        self.code = codewords(len(languages))
        plus, minus = np.zeros((2, self.code.shape[1], BUCKETS))
        done = 0
        for counts in blocks:
            p = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
            up = (self.code[done : done + len(counts)] > 0).astype(float)
            plus += up.T @ p
            minus += (1 - up).T @ p
            done += len(counts)
        ups = (self.code > 0).sum(axis=0)[:, None]
        both = (plus + minus) / len(languages)
        odds = np.log(np.where(ups > 0, plus / np.maximum(ups, 1), both)) - np.log(np.where(ups < len(languages), minus / np.maximum(len(languages) - ups, 1), both))
        self.weights = list(odds.astype(np.float32))

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, loss margin to the next codeword) of non-empty texts that start at `at`."""
        ends = np.append(at[1:], len(data))
        two, three = _ngrams(data, ends)
        n = ends - at
        margins = np.stack([(np.add.reduceat(w[two] + w[three], at)) / n for w in self.weights], axis=1)
        loss = np.exp(-np.clip(margins[:, None, :] * self.code[None], -30, 30)).mean(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = np.take_along_axis(loss, order[:, :1], 1)[:, 0]
        inverse = 1 / (loss + 1e-9) ** 3
        score = inverse.max(axis=1) / inverse.sum(axis=1)
        second = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] if loss.shape[1] > 1 else np.full(len(best), np.inf)
        return order[:, 0], score, second / (best + 1e-9)


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of all rows with a language; None if there are none."""
    rows = texts.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = cut(counts, "ngrams")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None

    def blocks() -> Iterator[np.ndarray]:
        for i in range(0, len(languages), LANGUAGES_AT_ONCE):
            own = {x: k for k, x in enumerate(languages[i : i + LANGUAGES_AT_ONCE])}
            table = counts.where(F.col("lang").isin(list(own))).toArrow()  # LANGUAGES_AT_ONCE x BUCKETS rows at most
            matrix = np.zeros((len(own), BUCKETS))
            for part in table.to_batches():
                name = part.column(0).dictionary_encode()
                which = np.array([own[x] for x in name.dictionary.to_pylist()])[name.indices.to_numpy()] if len(part) else []
                matrix[which, part.column(1).to_numpy()] = part.column(2).to_numpy()
            yield matrix

    return Model(languages, blocks())


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", ambiguous_below: float = 1.15) -> DataFrame:
    """docs with __lang_pred, __lang_score (0 to 1) and __ambiguous (second best loss below so many times the best).

    Columns of docs with one of these three names are replaced; all others pass through, whatever their names.
    """
    text = F.col(text_col).cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    own = own_columns(docs, MADE)
    if model is None:
        return docs.select(*quoted(own), F.lit(UNKNOWN).alias(MADE[0]), F.lit(0.0).alias(MADE[1]), F.lit(True).alias(MADE[2]))
    names = pa.array(model.languages, pa.string())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            row, has = batch.columns
            body = row.field(place).cast(pa.string())
            for a, b, data, offsets in text_chunks(body, _CHUNK):
                at = offsets - offsets[0]
                full = np.flatnonzero((np.diff(at) > 0) & has.slice(a, b - a).to_numpy(zero_copy_only=False))
                lang: np.ndarray = np.full(b - a, -1)
                score, close = np.zeros(b - a), np.ones(b - a, bool)
                if len(full):
                    some = np.flatnonzero(np.diff(at) > 0)
                    which, s, ratio = m.predict(data, at[some])
                    k = np.isin(some, full)
                    lang[full], score[full], close[full] = which[k], s[k], ratio[k] < ambiguous_below
                named = names.take(pa.array(np.maximum(lang, 0)))
                pred = pc.if_else(pa.array(lang >= 0), named, pa.scalar(UNKNOWN))
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), pred, pa.array(score), pa.array(close)], ["row", *MADE])

    place = [c.lower() for c in own].index(text_col.lower())
    rows = docs.select(F.struct(*quoted(own)).alias("row"), letters.alias("letters"))
    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField(MADE[0], StringType()), StructField(MADE[1], DoubleType()), StructField(MADE[2], BooleanType())])
    return rows.mapInArrow(run, schema).select("row.*", *MADE)
