"""Toxicity scores: Levenshtein automata over a lexicon trie, and windows of context.

Learning, over all labelled training texts: words and word stems (`lowei*`) of any length are counted by label per
task and summed; all with strong log odds make the lexicon, a table. Up to BROADCAST_BYTES of terms it is broadcast as
one trie; beyond, in shards by a hash of the term, each run over all texts, and the hits are joined by text. Scoring streams every word of every whole text. A word that shares a half with some entry, which one edit
cannot avoid, is run through the trie under a Levenshtein automaton of distance one, so that misspelled terms count
too. Around each hit a window of context tells quotation (quote marks open
around it) from abuse. A logistic model over the counts and the best windows gives the score; it is fitted on a
bounded sample of about FIT_ROWS labelled texts, chosen by a hash of the id.

Null and blank texts have no hits and get the score of such texts. A row whose id has several labels counts as toxic
if any says so; labels without a document, or that are null, teach nothing. Without both classes the score is the
share of toxic labels. Rows with null ids are scored. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import Words, broadcast_if_small, cut, word_chunks

#: Bytes of terms in one broadcast trie (about 250 bytes of memory each).
BROADCAST_BYTES = 200_000
#: Terms that a task counts before it hands them on.
COUNTED = 500_000
MIN_TEXTS = 3
#: Log-likelihood ratio (nats) by which a term must beat chance.
EVIDENCE = 9.0
FIT_ROWS = 50_000
#: Labels (16 bytes each) up to which they are broadcast to the texts; beyond, texts and labels are shuffled once.
BROADCAST_LABELS = 500_000
WINDOW = 12
STEMS = (4, 5, 6)
FEATURES = ("exact", "near", "quoted", "best", "any", "density")
_TRIM = np.zeros(256, bool)
_TRIM[:128] = True
_TRIM[48:58] = _TRIM[65:91] = _TRIM[97:123] = False


def _trimmed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and ends without ASCII punctuation around."""
    s, e = w.starts.copy(), w.ends.copy()
    if not len(s):
        return s, e
    # the next byte that isn't punctuation, and the last one before
    plain = np.flatnonzero(~_TRIM[w.data])
    if not len(plain):
        return s, s.copy()
    first = plain[np.minimum(np.searchsorted(plain, s), len(plain) - 1)]
    last = plain[np.maximum(np.searchsorted(plain, e) - 1, 0)] + 1
    some = (first >= s) & (first < e)
    return np.where(some, first, s), np.where(some, last, s)


def _terms(word: bytes) -> Iterator[bytes]:
    """The word, and its stems marked by a star."""
    yield word
    for n in STEMS:
        if len(word) > n and word[n] & 0xC0 != 0x80:  # not within a character
            yield word[:n] + b"*"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each term: (term, toxic, n); a term may come several times."""
    counts = (Counter(), Counter())

    def rows(least: int) -> Iterator[pa.RecordBatch]:
        for label in (0, 1):
            if len(counts[label]) > least:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts[label]), pa.binary()), pa.array([label] * len(counts[label]), pa.int32()), pa.array(list(counts[label].values()), pa.int64())], ["term", "toxic", "n"])
                counts[label].clear()

    for batch in batches:
        toxic = batch.column(1).to_pylist()
        for a, b, w in word_chunks(batch.column(0), lower=True):
            s, e = _trimmed(w)
            raw = w.data.tobytes()
            for row in range(b - a):
                i, j = w.bounds[row], w.bounds[row + 1]
                own = {raw[x:y] for x, y in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True) if y > x}
                counts[toxic[a + row]].update({t for x in own for t in _terms(x)})
            yield from rows(COUNTED)
    yield from rows(0)


class Trie:
    """The lexicon's trie intersected with the Levenshtein automaton of distance one.

    A state is a set of (trie node, edits so far); it is determinised as words need it, so that a word costs a lookup
    a letter, and most words end in the empty set after a few.
    """

    def __init__(self, terms: dict[bytes, float]):
        self.below: list[dict[str, int]] = [{}]
        self.whole: dict[int, float] = {}
        self.stems: dict[int, float] = {}
        self.heads = np.zeros(1 << 24, bool)
        self.tails = np.zeros(1 << 24, bool)
        codes: dict[str, set[bytes]] = {"heads": set(), "tails": set()}
        for term, weight in terms.items():
            stem = term.endswith(b"*")
            body = term.rstrip(b"*")
            node = 0
            for c in body.decode("utf-8", "replace"):
                if c not in self.below[node]:
                    self.below[node][c] = len(self.below)
                    self.below.append({})
                node = self.below[node][c]
            ends = self.stems if stem else self.whole
            ends[node] = max(weight, ends.get(node, 0.0))
            letters = body.decode("utf-8", "replace")
            short = len(letters) < 4  # never misspelled: the word's own head is enough
            # one edit leaves one of the two halves as it is; halves are of whole letters
            half = len(letters) // 2
            codes["heads"].add(body[:3] if short else letters[:half].encode()[:3])
            if not stem and not short:
                codes["tails"].add(letters[half:].encode()[-3:])
        x = np.arange(1 << 16, dtype=np.uint32)
        for c in codes["heads"]:
            self.heads[int.from_bytes(c, "big") << 8 * (3 - len(c)) | x[: 1 << 8 * (3 - len(c))]] = True
        for c in codes["tails"]:
            self.tails[x[: 1 << 8 * (3 - len(c))] << np.uint32(8 * len(c)) | np.uint32(int.from_bytes(c, "big"))] = True
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple] = []
        self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        """Number of a set of places, closed under skipping a letter of the trie; -1 if there are none."""
        closed = set(places)
        for node, e in places:
            if e == 0:
                closed.update((n, 1) for n in self.below[node].values())
        closed = {(n, e) for n, e in closed if e == 0 or (n, 0) not in closed}
        if not closed:
            return -1
        key = frozenset(closed)
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, -self.whole[n]) for n, e in closed if n in self.whole]
            stems = [(0, -self.stems[n]) for n, e in closed if e == 0 and n in self.stems]  # too short to be misspelled safely
            self.accepts.append((min(ends, default=None), min(stems, default=None)))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if c in self.below[node]:
                out.add((self.below[node][c], e))
            if e == 0:
                out.add((node, 1))  # a letter too many
                out.update((n, 1) for n in self.below[node].values())  # another letter
        self.moves[state][c] = self._state(out)
        return self.moves[state][c]

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, distance) of the nearest entry, heavier first; words of fewer than five letters only as they are."""
        state, best = 0, None
        for c in word:
            after = self.moves[state].get(c)
            state = self._move(state, c) if after is None else after
            if state < 0:
                break
            stem = self.accepts[state][1]
            if stem and (best is None or stem < best):
                best = stem
        else:
            end = self.accepts[state][0]
            if end and (end[0] == 0 or len(word) >= 5) and (best is None or end < best):
                best = end
        return (-best[1], best[0]) if best else None


def _candidates(w: Words, s: np.ndarray, e: np.ndarray, trie: Trie) -> np.ndarray:
    """Words that share a half with an entry."""
    if not len(s):
        return s
    d = w.data.astype(np.uint32)
    at = lambda i: d[np.clip(i, 0, len(d) - 1)]
    head = at(s) << 16 | at(s + 1) << 8 | at(s + 2)
    tail = at(e - 3) << 16 | at(e - 2) << 8 | at(e - 1)
    return np.flatnonzero((e > s) & (trie.heads[head] | trie.tails[tail]))


def _found(w: Words, trie: Trie, cache: dict[bytes, tuple[float, int] | None]) -> dict[int, list[tuple[int, float, int, bool]]]:
    """Hits of each text that has some: (word, weight, distance, quoted)."""
    s, e = _trimmed(w)
    raw = w.data.tobytes()
    hits: dict[int, list[tuple[int, float, int, bool]]] = {}
    some = _candidates(w, s, e, trie)
    for k, row in zip(some.tolist(), (np.searchsorted(w.bounds, some, "right") - 1).tolist(), strict=True):
        x = raw[s[k] : e[k]]
        if x in cache:
            m = cache[x]
        else:
            m = trie.match(x.decode("utf-8", "replace"))
            if len(cache) < 200_000:
                cache[x] = m
        if m:
            i, j = int(w.bounds[row]), int(w.bounds[row + 1])
            before = raw[w.starts[max(i, k - WINDOW)] : s[k]]
            after = raw[e[k] : w.ends[min(j, k + WINDOW) - 1]]
            hits.setdefault(row, []).append((k - i, *m, _quoted(before, after)))
    return hits


def _vector(found: list[tuple[int, float, int, bool]], words: int) -> tuple[float, ...]:
    """The features of a text from its hits in order."""
    exact = near = quoted = 0.0
    places, weights = [], []
    for k, weight, d, inside in found:
        quoted += inside
        near += d > 0 and not inside
        exact += d == 0 and not inside
        places.append(k)
        weights.append(weight * (0.5 if d else 1.0) * (0.3 if inside else 1.0))
    places, weights = np.array(places), np.array(weights)
    totals = np.cumsum(np.append(0, weights))
    best = (totals[np.searchsorted(places, places + WINDOW, "right")] - totals[:-1]).max()
    return np.log1p(exact), np.log1p(near), np.log1p(quoted), np.log1p(best), 1.0, np.log1p(100 * (exact + near) / words)


def _features(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = shared.value
        cache: dict[bytes, tuple[float, int] | None] = {}
        for batch in batches:
            names = batch.schema.names
            for a, b, w in word_chunks(batch.column(names.index("text")), lower=True):
                out = np.zeros((b - a, len(FEATURES)))
                for row, found in _found(w, trie, cache).items():
                    out[row] = _vector(found, int(w.bounds[row + 1] - w.bounds[row]))
                yield pa.RecordBatch.from_arrays([batch.column(names.index(c)).slice(a, b - a) for c in keep] + [pa.array(out[:, f]) for f in range(len(FEATURES))], keep + list(FEATURES))

    return run


def _hits(shared):
    """The hits of one shard: (key, place, distance, weight, quoted, words) of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: Trie = shared.value
        cache: dict[bytes, tuple[float, int] | None] = {}
        for batch in batches:
            for a, b, w in word_chunks(batch.column(1), lower=True):
                rows = [(a + row, k, d, weight, inside, int(w.bounds[row + 1] - w.bounds[row])) for row, found in _found(w, trie, cache).items() for k, weight, d, inside in found]
                if rows:
                    row, *rest = zip(*rows, strict=True)
                    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row))] + [pa.array(x, kind) for x, kind in zip(rest, kinds, strict=True)], ["key", "place", "distance", "weight", "quoted", "words"])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of (key, words, hits)."""
    for batch in batches:
        if batch.num_rows:
            own = [sorted((h["place"], h["best"]["weight"], h["best"]["distance"], h["quoted"]) for h in hits) for hits in batch.column(2).to_pylist()]
            out = np.array([_vector([(k, -w, d, q) for k, w, d, q in hits], words) for hits, words in zip(own, batch.column(1).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(out[:, f]) for f in range(len(FEATURES))], ["key", *FEATURES])


def features(texts: DataFrame, keep: list[str], tries: list) -> DataFrame:
    """The columns keep of texts with FEATURES, under one broadcast trie or several shards of it."""
    columns = ", ".join(f"{f} double" for f in FEATURES)
    if len(tries) == 1:
        kinds = "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in keep)
        return texts.select("text", *keep).mapInArrow(_features(tries[0], keep), kinds + columns)
    keyed = texts.withColumn("key", F.sha2("text", 256))
    hits = None
    for trie in tries:
        own = keyed.select("key", "text").where("text is not null").mapInArrow(_hits(trie), "key string, place int, distance int, weight double, quoted boolean, words int")
        hits = own if hits is None else hits.unionByName(own)
    best = hits.groupBy("key", "place").agg(F.min(F.struct("distance", (-F.col("weight")).alias("weight"))).alias("best"), F.first("quoted").alias("quoted"), F.first("words").alias("words"))
    rows = best.groupBy("key").agg(F.first("words").alias("words"), F.collect_list(F.struct("place", "best", "quoted")).alias("hits"))
    found = rows.mapInArrow(_gather, f"key string, {columns}")
    return keyed.select("key", *keep).join(found, "key", "left").select(*keep, *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES])


def _quoted(before: bytes, after: bytes) -> bool:
    """An odd number of quote marks before within the window and one behind, or an opening typographic mark left open."""
    straight = before.count(b'"') % 2 == 1 and b'"' in after
    curly = before.rfind("“".encode()) > before.rfind("”".encode()) or before.rfind("«".encode()) > before.rfind("»".encode())
    return straight or curly


def learn_lexicon(labelled: DataFrame) -> DataFrame:
    """(term, odds) from (text, toxic) rows: all terms that pass, but for those that a stronger stem begins."""
    spark = labelled.sparkSession
    totals = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return spark.createDataFrame([], "term binary, odds double")
    n, m = F.col("n"), F.col("m")
    share = totals[1] / (totals[0] + totals[1])
    x = F.log((n + 0.5) / (totals[1] + 1)) - F.log((m + 0.5) / (totals[0] + 1))
    gain = n * F.log(n / (n + m) / share) + F.when(m > 0, m * F.log(m / (n + m) / (1 - share))).otherwise(0.0)
    counts = labelled.select("text", "toxic").mapInArrow(_count, "term binary, toxic int, n long").groupBy("term").agg(F.sum(F.col("n") * F.col("toxic")).alias("n"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("m"))
    some = counts.where((n >= MIN_TEXTS) & (n >= 4 * m)).withColumn("odds", x).where((F.col("odds") >= 2.5) & (gain >= EVIDENCE))
    passed = cut(some.select("term", "odds", (n * F.col("odds")).alias("strength")), "terms")
    # a stem that another one hides is itself begun by that one, so no order of choice is needed
    stems = passed.where("substring(term, length(term), 1) = X'2A'").select(F.expr("substring(term, 1, length(term) - 1)").alias("head"), F.col("term").alias("stem"), F.col("strength").alias("own"))
    heads = passed.select("term", "strength", F.explode(F.array(*[F.substring("term", 1, k) for k in STEMS])).alias("head"))
    hidden = heads.join(stems, "head").where("term <> stem and (own > strength or own = strength and stem < term)").select("term").distinct()
    return cut(passed.join(hidden, "term", "left_anti").select("term", "odds"), "lexicon")


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, held_out: str = "held_out", bound: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, held_out, score, hit counts as logs) of all rows of docs (doc_id, text, held_out); learns where held_out is false."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(held_out).alias("held_out"))
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    labels_known = marks.count()
    teach = docs.where("not held_out").join(broadcast_if_small(marks, labels_known, BROADCAST_LABELS), "doc_id").select("doc_id", "text", "toxic")
    if labels_known > BROADCAST_LABELS:
        teach = cut(teach, "labelled")  # the texts have moved; they are read several times from here on
    lexicon = learn_lexicon(teach)
    terms, length = lexicon.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    shards = max(1, -(-length // bound))
    tries = []
    for k in range(shards):
        own = lexicon.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == k) if shards > 1 else lexicon
        tries.append(spark.sparkContext.broadcast(Trie({bytes(r[0]): r[1] for r in own.collect()})))  # about `bound` bytes of terms
    labelled = teach.count()
    share = min(1.0, FIT_ROWS / max(labelled, 1))
    sample = teach.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < round(share * (1 << 20))).select("text", "toxic")
    rows = features(sample, ["toxic"], tries).toPandas()
    y = rows["toxic"].to_numpy(float)
    if not terms or not 0 < y.mean() < 1:
        w = np.zeros(len(FEATURES) + 1)
        toxic = y.mean() if len(y) else 0.0
        w[-1] = np.log((toxic + 1e-3) / (1 - toxic + 1e-3))
    else:
        w = _fit(rows[list(FEATURES)].to_numpy(), y)
    z = F.lit(float(w[-1]))
    for f, v in zip(FEATURES, w, strict=False):
        z = z + F.lit(float(v)) * F.col(f)
    scored = features(docs, ["doc_id", "held_out"], tries)
    return scored.withColumn("score", 1 / (1 + F.exp(-z)))


