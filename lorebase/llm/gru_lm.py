"""Language-model scores: a gated recurrent network with a class-factored output softmax, in numpy inside Spark tasks.

Counts. Words are counted per task and summed over the cluster; the table grows with the corpus and is never
gathered. Its FREQUENT most frequent words (a bounded table) are known to every task; the counts of all others reach
the documents through a join.

Output. The NEURAL most frequent words (the end sign among them) form classes of CLASS_SIZE by rank, with a softmax
over the classes and one within the class. All other words, known or not, fall into tail classes by frequency band
and by the first letter outside ASCII; within such a class a word has its smoothed share of the class's counts. So
every word of any text has a probability, and unknown words share what the smoothing leaves them.

Training. Every word of every training text is a target of truncated backpropagation in windows of BPTT words; BATCH
texts run side by side, with the state carried from each window into the next until the text ends. In each of ROUNDS rounds the tasks start from the same weights, run
Adam over their texts, and the weights are averaged by words seen, first within and then across groups of tasks.

Scoring. SIDE texts of like length run side by side in windows of STEPS words, with the state carried across the windows until each text
and its end sign are done, so the score is that of the whole text, whatever its length.

Null texts count as empty: they have the end sign only. Without training texts every probability is 1 and all scores
are 0. Repeated rows get their scores once per row. Rows with null ids are scored. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import Words, cut, lists, mix, word_chunks

FREQUENT = 1 << 18
BUCKETS = 1 << 18
NEURAL = 2048
CLASS_SIZE = 64
CLASSES = NEURAL // CLASS_SIZE
BANDS, LETTERS = 2, 8
TAILS = BANDS * LETTERS
INPUTS = NEURAL + TAILS + 1
HIDDEN = 24
BPTT, BATCH = 16, 64
ROUNDS = 3
RATE = 0.02
STEPS = 16
SIDE = 512
GROUP_TOKENS = 4_000_000
END = np.int64(-1)
_LN10 = float(np.log(10))
_F = np.float32


def letters(w: Words) -> np.ndarray:
    """Tail class part of each word: by its first byte above 127 with the next one; 0 if all is ASCII."""
    high = np.flatnonzero(w.data >= 0x80)
    out = np.zeros(len(w.starts), np.int64)
    if len(high):
        at = np.searchsorted(high, w.starts)
        first = high[np.minimum(at, len(high) - 1)]
        has = (at < len(high)) & (first < w.ends)
        pair = w.data[first].astype(np.uint64) << np.uint64(8) | w.data[np.minimum(first + 1, len(w.data) - 1)]
        out[has] = (mix(pair[has]) % np.uint64(LETTERS - 1)).astype(np.int64) + 1
    return out


def _keys(w: Words) -> np.ndarray:
    h = w.hashes.astype(np.int64)
    h[h == END] = 0
    return h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    texts = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, g, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return u, g[first], np.bincount(inverse, weights=c, minlength=len(u)).astype(np.int64)

    for batch in batches:
        texts += batch.num_rows
        for _, _, w in word_chunks(batch.column(0), lower=True, limit=1 << 22):
            u, first, c = np.unique(_keys(w), return_index=True, return_counts=True)
            parts.append((u, letters(w)[first], c))
            if len(parts) > 8:
                parts = [merged()]
    if texts:
        parts.append((np.array([END]), np.array([0]), np.array([texts])))
        u, g, c = merged()
        for k in range(0, len(u), 200_000):
            s = slice(k, k + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(u[s]), pa.array(g[s].astype(np.int32)), pa.array(c[s].astype(np.int64))], ["h", "letter", "c"])


class Vocabulary:
    """The frequent words: sorted hashes, ids by rank, counts; and what the tail classes weigh."""

    def __init__(self, h: np.ndarray, letter: np.ndarray, c: np.ndarray, tail: np.ndarray):
        """In order of rank; tail: sum of c + 0.5 over the words beyond, by letter."""
        rank = np.arange(len(h))
        order = np.argsort(h)
        self.h, self.rank, self.letter = h[order], rank[order], letter[order]
        self.logs = np.log(c[order] + 0.5)
        self.counts = c
        self.first = np.searchsorted(self.h, np.arange(-BUCKETS // 2, BUCKETS // 2) * ((1 << 64) // BUCKETS)).astype(np.int32)
        self.end = int(np.flatnonzero(h == END)[0])
        weights = np.zeros((BANDS, LETTERS))
        mid = rank >= NEURAL
        np.add.at(weights[0], letter[mid], c[mid] + 0.5)
        weights[1] = tail + 0.5
        self.tail_logs = np.log(np.maximum(weights, 0.5)).ravel()
        self.tail_weights = weights.ravel()

    def code(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(input id, log(c + 0.5) or nan, hash, tail class or -1) of each word."""
        h = _keys(w)
        at, top = self.first[h // ((1 << 64) // BUCKETS) + BUCKETS // 2], len(self.h) - 1
        at = np.minimum(at, top)
        behind = np.flatnonzero((self.h[at] < h) & (at < top))  # few steps: a bucket of hashes has about one
        while len(behind):
            at[behind] += 1
            on = at[behind]
            behind = behind[(self.h[on] < h[behind]) & (on < top)]
        known = self.h[at] == h
        logs = np.where(known, self.logs[at], np.nan)
        rank = np.where(known, self.rank[at], -1)
        tail = np.where(known, 0, LETTERS) + letters(w)
        neural = known & (rank < NEURAL)
        return np.where(neural, rank, NEURAL + tail).astype(np.int32), logs, h, np.where(neural, -1, tail)


def initial(v: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    """Small random weights; the biases give the words' and classes' frequencies."""
    rng = np.random.default_rng(seed)
    c = np.full(NEURAL, 0.5)
    c[: min(NEURAL, len(v.counts))] += v.counts[:NEURAL]
    classes = np.concatenate([c.reshape(CLASSES, CLASS_SIZE).sum(axis=1), np.maximum(v.tail_weights, 0.5)])
    word = np.log(c.reshape(CLASSES, CLASS_SIZE) / c.reshape(CLASSES, CLASS_SIZE).sum(axis=1, keepdims=True))
    p = {
        "e": rng.normal(0, 0.3, (INPUTS, 3 * HIDDEN)),
        "u": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)),
        "wc": rng.normal(0, 0.05, (HIDDEN, CLASSES + TAILS)),
        "bc": np.log(classes / classes.sum()),
        "ww": rng.normal(0, 0.05, (CLASSES, HIDDEN, CLASS_SIZE)),
        "bw": word,
    }
    p["e"][:, :HIDDEN] += 1.0  # keep the state at first
    return {k: x.astype(_F) for k, x in p.items()}


def _parts(a: np.ndarray) -> np.ndarray:
    """The update gate's, the reset gate's and the candidate's part of the last axis, as first axis; those of the gates negated."""
    k = a.ndim - 1
    parts = np.ascontiguousarray(a.reshape(*a.shape[:-1], 3, HIDDEN).transpose(k, *range(k), k + 1))
    np.negative(parts[:2], out=parts[:2])
    return parts


def _unit(a: np.ndarray, r: np.ndarray, h: np.ndarray, new: np.ndarray, gates: np.ndarray, n: np.ndarray) -> None:
    """One step of the gated unit from the parts of its inputs a and of its recurrent inputs r: puts new state, gates and candidate into their places."""
    np.add(a[:2], r[:2], out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[1], r[2], out=n)
    n += a[2]
    np.tanh(n, out=n)
    np.subtract(h, n, out=new)
    new *= gates[0]
    new += n


def step(p: dict[str, np.ndarray], a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the gated unit from inputs a and state h: (new state, both gates, candidate)."""
    new, n, gates = np.empty_like(h), np.empty_like(h), np.empty((2, *h.shape), h.dtype)
    _unit(_parts(a), h @ _parts(p["u"]), h, new, gates, n)
    return new, gates, n


def _softmax(x: np.ndarray, own: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """ln of the share of each row's own column, and the sum of the row's exponentials, which take the place of x; no |x| is above bound."""
    if not bound < 60:  # else exp() stays far from the ends of 32-bit numbers
        x -= x.max(axis=1, keepdims=True)
    mine = x[np.arange(len(x)), own]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return mine - np.log(total), total


def _error(x: np.ndarray, own: np.ndarray, total: np.ndarray, n: int) -> None:
    """Turn exponentials into the gradient of the loss, a mean over n rows, by what they are of."""
    x *= (1 / (total * n))[:, None]
    x[np.arange(len(x)), own] -= 1 / n


def output(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray, grad: bool = False):
    """ln P of each target's class and, for neural words, of the word in its class; with grad, also the gradients of the mean loss.

    The rows go in order of class, neural ones first: a class's words are a product over its slice, all else is done at once.
    """
    cls = np.where(target < NEURAL, target // CLASS_SIZE, target - NEURAL + CLASSES).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    cls, word = cls[order], target[order] % CLASS_SIZE
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    slices = [(c, a, b) for c, a, b in zip(range(CLASSES), cuts, cuts[1:], strict=False) if a < b]
    m = cuts[CLASSES]
    own = np.ones((len(h), HIDDEN + 1), h.dtype)  # the last one meets the biases
    own[:, :HIDDEN] = h[order]
    wc, ww = np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["ww"], p["bw"][:, None]], axis=1)
    most = max(float(own.max()), -float(own.min()))
    x = own @ wc
    y = np.empty((m, CLASS_SIZE), x.dtype)
    for c, a, b in slices:
        np.dot(own[a:b], ww[c], out=y[a:b])
    sorted_ln, total = _softmax(x, cls, most * np.abs(wc).sum(axis=0).max())
    word_ln, word_total = _softmax(y, word[:m], most * np.abs(ww).sum(axis=1).max())
    sorted_ln[:m] += word_ln
    ln = np.empty_like(sorted_ln)
    ln[order] = sorted_ln
    if not grad:
        return ln
    _error(x, cls, total, len(h))
    _error(y, word[:m], word_total, len(h))
    gc, gw = own.T @ x, np.zeros_like(ww)
    back, more = x @ p["wc"].T, np.empty((m, HIDDEN), x.dtype)
    for c, a, b in slices:
        np.dot(own[a:b].T, y[a:b], out=gw[c])
        np.dot(y[a:b], p["ww"][c].T, out=more[a:b])
    back[:m] += more
    dh = np.empty_like(back)
    dh[order] = back
    return ln, {"wc": gc[:-1], "bc": gc[-1], "ww": np.ascontiguousarray(gw[:, :-1]), "bw": np.ascontiguousarray(gw[:, -1]), "h": dh}


def train_window(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Truncated backpropagation over inputs x and targets y (time, texts): gradients to descend, last state, mean loss.

    What of the gradients needs no state of another step is computed for all steps at once.
    """
    time, k = len(x), HIDDEN
    a, u = _parts(p["e"][x]), _parts(p["u"])
    states = np.empty((time + 1, *h.shape), a.dtype)
    r, gates, n = np.empty_like(a), np.empty((2, *a.shape[1:]), a.dtype), np.empty(a.shape[1:], a.dtype)
    states[0] = h
    for t in range(time):
        np.matmul(states[t], u, out=r[:, t])
        _unit(a[:, t], r[:, t], states[t], states[t + 1], gates[:, t], n[t])
    ln, g = output(p, states[1:].reshape(-1, k), y.ravel(), grad=True)
    dh = g.pop("h").reshape(time, -1, k)
    rest = 1 - gates
    by = np.empty_like(a)  # what dh is multiplied by for the update gate, the reset gate and the candidate's recurrent part
    dn = rest[0] * (1 - n * n)
    np.multiply(states[:-1] - n, gates[0], out=by[0])
    by[0] *= rest[0]
    np.multiply(dn, gates[1], out=by[2])
    np.multiply(by[2], r[2], out=by[1])
    by[1] *= rest[1]
    back = np.ascontiguousarray(p["u"].reshape(k, 3, k).transpose(1, 2, 0))
    du = np.empty_like(a)
    for t in reversed(range(time)):
        np.multiply(dh[t], by[:, t], out=du[:, t])
        if t:
            d = dh[t] * gates[0, t]
            for more in du[:, t] @ back:
                d += more
            dh[t - 1] += d
    g["u"] = np.concatenate(list(states[:-1].reshape(-1, k).T @ du.reshape(3, -1, k)), axis=1)
    np.multiply(dh, dn, out=du[2])  # the candidate's own input
    g["e"] = np.zeros_like(p["e"])
    at = (x.reshape(-1, 1) * (3 * k) + np.arange(k)) + (np.arange(3) * k)[:, None, None]
    np.add.at(g["e"].reshape(-1), at.ravel(), du.ravel())  # with an index for each number it is fast
    return g, states[-1], -float(ln.mean())


def _long_first(texts: pa.Array) -> pa.Array:
    """The texts, those of over twice the mean length before the others: so none of them is left to run alone at the end."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return texts.take(pa.array(np.argsort(n <= 2 * n.mean(), kind="stable"))) if len(n) else texts


def _train(shared):
    """Adam over the texts of a task; out come its weights in pieces and how many words it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, start = shared.value
        p = {k: x.copy() for k, x in start.items()}
        m = {k: np.zeros_like(x) for k, x in p.items()}
        s = {k: np.zeros_like(x) for k, x in p.items()}
        seen, steps, m_by, s_by = 0, 0, 1.0, 1.0
        met = np.zeros(INPUTS, bool)  # inputs since the last step
        texts: list[np.ndarray] = []  # those that run, each with what is left of it
        h = np.zeros((0, HIDDEN), _F)
        gathered: dict[str, np.ndarray] = {}
        size = 0

        def descend(g: dict[str, np.ndarray], size: int) -> None:
            """A step of Adam in place, along gradients summed over so many words.

            m and s decay through one factor each, so a step writes only the rows of them whose inputs occurred.
            """
            nonlocal steps, m_by, s_by
            steps += 1
            m_by, s_by = m_by * 0.9, s_by * 0.99
            root = np.sqrt(1 - 0.99**steps)
            rate = RATE / np.sqrt(1 + steps / 200) * root / (1 - 0.9**steps)
            rows = np.flatnonzero(met)
            met[:] = False
            for name, x in g.items():
                own = x[rows] if name == "e" else x
                own *= _F(0.1 / size)
                at = rows if name == "e" else slice(None)
                m[name][at] += own * _F(1 / m_by)
                own *= own  # 0.01 times the gradient's square
                own *= _F(1 / s_by)
                s[name][at] += own
                np.sqrt(s[name], out=x)
                x += _F(1e-5 * root / np.sqrt(s_by))
                np.divide(m[name], x, out=x)
                x *= _F(rate * m_by / np.sqrt(s_by))
                p[name] -= x
            if m_by < 1e-4:
                for name in p:
                    m[name] *= _F(m_by)
                    s[name] *= _F(s_by)
                m_by = s_by = 1.0

        def advance() -> None:
            """One window of all running texts; those that end leave. Weights move once BATCH windows are gathered."""
            nonlocal seen, size, texts, gathered, h
            tokens = np.full((len(texts), BPTT + 1), v.end)  # the end sign stands in for what is missing
            for k, own in enumerate(texts):
                tokens[k, : len(own)] = own[: BPTT + 1]
            tokens = np.ascontiguousarray(tokens.T)
            g, h, _ = train_window(p, tokens[:-1], tokens[1:], h)
            met[tokens[:-1]] = True
            n = BPTT * len(texts)
            seen += n
            if n == BATCH * BPTT and not size:
                descend(g, 1)
            else:
                for name, x in g.items():
                    x *= _F(n)
                    gathered[name] = gathered[name] + x if name in gathered else x
                size += n
                if size >= BATCH * BPTT:
                    descend(gathered, size)
                    gathered, size = {}, 0
            live = [k for k, own in enumerate(texts) if len(own) > BPTT + 1]
            h = h[live] if len(live) < len(texts) else h
            texts = [texts[k][BPTT:] for k in live]

        for batch in batches:
            for a, b, w in word_chunks(_long_first(batch.column(0)), lower=True):
                ids = v.code(w)[0]
                for row in range(b - a):
                    own = np.concatenate([[INPUTS - 1], ids[w.bounds[row] : w.bounds[row + 1]], [v.end]])
                    texts.append(own)
                    h = np.concatenate([h, np.zeros((1, HIDDEN), _F)])
                    while len(texts) == BATCH:
                        advance()
        while texts:
            advance()
        if size:
            descend(gathered, size)
        if seen:
            flat = np.concatenate([p[k].ravel() for k in sorted(p)])
            pieces = range(0, len(flat), 8192)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array([float(seen)] * len(pieces)), pa.array([flat[k : k + 8192].tobytes() for k in pieces], pa.binary())], ["piece", "seen", "weights"]
            )

    return run


def _average(frame: pd.DataFrame) -> pd.DataFrame:
    total, seen = None, 0.0
    for w, n in zip(frame["weights"], frame["seen"], strict=True):
        x = np.frombuffer(w, _F).astype(np.float64) * n
        total = x if total is None else total + x
        seen += n
    return pd.DataFrame({"piece": [frame["piece"].iloc[0]], "seen": [seen], "weights": [(total / seen).astype(_F).tobytes()]})


def train(texts: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Weights after ROUNDS rounds over texts (key, text)."""
    spark = texts.sparkSession
    p = initial(v)
    schema = "piece int, seen double, weights binary"
    for k in range(ROUNDS):
        mine = texts.where(F.pmod("key", F.lit(ROUNDS)) == k).select("text")
        got = mine.mapInArrow(_train(spark.sparkContext.broadcast((v, p))), schema).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(64)))
        got = got.groupBy("piece", "group").applyInPandas(_average, schema).groupBy("piece").applyInPandas(_average, schema)
        rows = sorted((r["piece"], r["weights"]) for r in got.collect())  # one set of weights
        if rows:
            flat, at = np.frombuffer(b"".join(w for _, w in rows), _F), 0
            for name in sorted(p):
                p[name] = flat[at : at + p[name].size].reshape(p[name].shape).copy()
                at += p[name].size
    return p


def log_likelihood(p: dict[str, np.ndarray], ids: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """ln P of the classes and neural words of each text (ids[bounds[i]:bounds[i + 1]]) with its end sign."""
    n = np.diff(bounds) + 1
    order = np.argsort(-n, kind="stable")
    n, first = n[order], bounds[:-1][order]
    out = np.zeros(len(n))
    u = _parts(p["u"])
    for k in range(0, len(n), SIDE):
        size, at = n[k : k + SIDE], first[k : k + SIDE]
        h = np.zeros((len(size), HIDDEN), p["e"].dtype)
        last = np.full(len(size), INPUTS - 1)
        for t0 in range(0, int(size[0]), STEPS):
            live = int(np.searchsorted(-size, -t0, "left"))
            h, last, left = h[:live], last[:live], size[:live] - t0
            width = min(STEPS, int(left[0]))
            steps = np.arange(width)[:, None]
            targets = np.where(steps < left - 1, ids[np.minimum(at[:live] + t0 + steps, len(ids) - 1)] if len(ids) else end, end)
            a = _parts(p["e"][np.concatenate([last[None], targets[:-1]])])
            states, gates, candidate = np.empty((width, *h.shape), h.dtype), np.empty_like(a[:2, 0]), np.empty_like(h)
            for t in range(width):
                _unit(a[:, t], h @ u, h, states[t], gates, candidate)
                h = states[t]
            last = targets[-1]
            real = steps < left
            ln = np.zeros(real.shape)
            ln[real] = output(p, states[real], targets[real])
            out[k : k + live] += ln.sum(axis=0)
    result = np.empty(len(n))
    result[order] = out
    return result


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value

        def done(group: list) -> pa.RecordBatch:
            rows = [x[0] for x in group]
            ids = np.concatenate([x[1] for x in group])
            counts = np.concatenate([x[2] for x in group])
            model = log_likelihood(p, ids, np.concatenate([[0], np.cumsum(counts)]), v.end) + np.concatenate([x[3] for x in group])
            known = np.concatenate([x[4] for x in group])
            rare, sizes = np.concatenate([x[5] for x in group]), np.concatenate([x[6] for x in group])
            own = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*own.columns, pa.array(counts.astype(np.int64)), pa.array(known), pa.array(model), lists(rare, sizes, pa.int64())], [*own.schema.names, "words", "known_log", "model", "rare"])

        group: list = []
        size = 0
        for batch in batches:
            own = batch.drop_columns(["text"])
            for a, b, w in word_chunks(batch.column(batch.schema.names.index("text")), lower=True):
                ids, logs, h, tail = v.code(w)
                n = np.diff(w.bounds)
                # within a tail class: the known part of the share; the log counts of rare words are joined later
                share = np.where(tail < 0, 0.0, np.nan_to_num(logs) - v.tail_logs[np.maximum(tail, 0)])
                sums = np.concatenate([[0], np.cumsum(share)])
                base = np.concatenate([[0], np.cumsum(np.nan_to_num(logs))])
                rare = np.isnan(logs)
                many = np.concatenate([[0], np.cumsum(rare)])
                group.append((own.slice(a, b - a), ids, n, np.diff(sums[w.bounds]), np.diff(base[w.bounds]), h[rare], np.diff(many[w.bounds])))
                size += len(ids)
                if size > GROUP_TOKENS:
                    yield done(group)
                    group, size = [], 0
        if group:
            yield done(group)

    return run


def _limit(counts: DataFrame, most: int) -> tuple[int, int]:
    """(c, h) of the last of the most frequent rows, by falling c and then by h; (0, 0) if there are no more rows than most.

    The driver sees how many rows have each count, then how many of the last count have each high part of the hash: no rows of the tasks' own first ones.
    """
    for c, k in counts.groupBy("c").count().orderBy(F.desc("c")).collect():  # distinct counts: with N words at most sqrt(2 N)
        if k > most:
            break
        most -= k
    else:
        return 0, 0
    if not most:
        return c + 1, (1 << 63) - 1
    part = F.shiftright("h", 48)
    for b, k in counts.where(F.col("c") == c).groupBy(part.alias("b")).count().orderBy("b").collect():  # at most 65,536 rows
        if k > most:
            break
        most -= k
    if not most:
        return c, (b << 48) - 1
    return c, counts.where((F.col("c") == c) & (part == b)).orderBy("h").limit(most).agg(F.max("h")).first()[0]


def score_documents(docs: DataFrame, held_out: str = "held_out") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text, held_out); learns where held_out is false."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(held_out).alias("held_out")).withColumn("key", F.xxhash64("doc_id", "text"))
    teach = rows.where("not held_out")
    counts = cut(teach.select("text").mapInArrow(_count, "h long, letter int, c long").groupBy("h").agg(F.min("letter").alias("letter"), F.sum("c").alias("c")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if not total:
        zero = F.lit(0.0)
        n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
        return rows.select("doc_id", "held_out", n.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    limit_c, limit_h = _limit(counts.where(F.col("h") != int(END)), FREQUENT - 1)
    rare = (F.col("h") != int(END)) & ((F.col("c") < limit_c) | ((F.col("c") == limit_c) & (F.col("h") > limit_h)))
    beyond = counts.where(rare)
    ranked = counts.where(~rare).toArrow().to_pandas().sort_values(["c", "h"], ascending=[False, True])  # at most FREQUENT rows
    first = ranked[ranked["h"] == END]
    rest = ranked[ranked["h"] != END]
    above = min(int((rest["c"] > first["c"].iloc[0]).sum()), NEURAL - 1)
    ranked = pd.concat([rest.iloc[:above], first, rest.iloc[above:]])
    tail = np.zeros(LETTERS)
    for letter, w in beyond.groupBy("letter").agg(F.sum(F.col("c") + 0.5)).collect():
        tail[letter] = w
    v = Vocabulary(ranked["h"].to_numpy(np.int64), ranked["letter"].to_numpy(np.int64), ranked["c"].to_numpy(np.int64), tail)
    p = train(teach.select("key", "text"), v)
    schema = "doc_id long, held_out boolean, key long, words long, known_log double, model double, rare array<long>"
    scored = cut(rows.select("doc_id", "text", "held_out", "key").mapInArrow(_score(spark.sparkContext.broadcast((v, p))), schema), "scores")
    rare = (
        scored.dropDuplicates(["key"]).select("key", F.explode("rare").alias("h"))
        .join(beyond.select("h", "c"), "h", "left")
        .groupBy("key")
        .agg(F.sum(F.log(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"), F.count("c").alias("rare_known"))
    )
    nothing = float(np.log(total + 0.5 * (kinds + 1)))
    end_log = float(v.logs[np.flatnonzero(v.h == END)[0]])
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    n = F.col("words") + 1
    return scored.join(rare, "key", "left").select(
        "doc_id", "held_out", n.alias("n_tokens"),
        (n - F.size("rare") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        ((F.col("known_log") + rare_log + end_log - n * nothing) / _LN10).alias("base_score"),
        ((F.col("model") + rare_log) / _LN10).alias("score"),
    )
