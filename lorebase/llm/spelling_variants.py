"""Grouping of spelling variants with k-d trees over letter counts.

Words that differ by one inserted, deleted or replaced letter have letter counts at an L1 distance of one or two: a
replacement takes one letter away and adds one, an insertion adds one. So the words of each length stand in a k-d tree
over their letter counts, and each word is searched for in the tree of its own length and in that of the next length
(a deletion is an insertion seen from the other word).

1. The upper part of a tree is fitted on a bounded sample (about SAMPLE words) and only decides how well the words are
   spread. Its cells are open boxes. Every word goes to the cell of its counts, and as a query to every other cell whose
   box is near enough; of two cells of one length the pair is looked for in the later one only.
2. Cells are dealt in pages of about PAGE words or PAGE_BYTES letters. A task holds one page, builds the lower part of
   the tree over its distinct counts with tight boxes, and streams the queries through. Boxes are pruned by the letters
   that would have to be added and taken away; leaves compare counts by the letters both have.
3. Pairs of counts become pairs of words, which are verified on the order of their letters, in chunks.

A task hands up what it found summed by word. Then each word has its near words' number and the one of largest n; its
form if that n is at least twice its own; and its root by pointer doubling over written tables. As n doubles with every
step, chains are short and have no cycles.

A null text has no words; a null id counts as empty text in the hash. Repeated rows count each. A table without words
of the asked length and frequency gives no rows. Extra columns are ignored. Words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import broadcast_if_small, cut

#: Letters of a word, once A-Z are lower case: a-z and U+00C0 to U+00FF, one byte each in Latin-1.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
_LETTER = np.full(256, -1, np.int64)
_LETTER[list(LOWER.encode())] = np.arange(26)
_LETTER[0xC0:] = np.arange(26, 90)
LETTERS = 90
SAMPLE = 1 << 16
PAGE, PAGE_BYTES = 1 << 14, 1 << 22
#: Different letter counts of a leaf.
LEAF = 128
#: Letters of the word pairs that are verified at a time.
CHUNK = 1 << 25
#: Letter levels up to which counts are compared by one product.
LEVELS = 1024
_ROUTED = "len int, word string, n long, cell int, same array<int>, longer array<int>"
_FOUND = "word string, near long, best_n long, best string"


def typed_words(docs: DataFrame, every: int = 97, id_col: str = "doc_id", text_col: str = "text", least: int = 5) -> DataFrame:
    """(word): the runs of letters of all texts, A-Z lower-cased; where `every` divides a run's hash with its id one letter is left out."""
    text = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least).withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def codes_of(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """How often each letter stands in each row."""
    if not codes.size:
        return np.zeros((len(codes), LETTERS), np.int32)
    flat = _LETTER[codes] + LETTERS * np.arange(len(codes))[:, None]
    return np.bincount(flat.ravel(), minlength=len(codes) * LETTERS).reshape(len(codes), LETTERS).astype(np.int32)


def halves(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, level) that parts the rows most evenly into count <= level and above; None if all are equal."""
    middle = np.sort(counts, axis=0)[len(counts) // 2]
    best, at = 0, None
    for level in (middle - 1, middle):
        low = (counts <= level).sum(axis=0)
        even = np.minimum(low, len(counts) - low)
        c = int(even.argmax())
        if even[c] > best:
            best, at = int(even[c]), (c, int(level[c]))
    return at


def upper_tree(counts: np.ndarray, cells: int) -> tuple[tuple | int, int]:
    """(tree, number of its cells): nested (letter, level, least, most, low, high), where the letter's count lies between least and most so far."""
    number = 0

    def grow(rows: np.ndarray, cells: int, least: dict, most: dict):
        nonlocal number
        at = halves(counts[rows]) if cells > 1 and len(rows) > 1 else None
        if at is None:
            number += 1
            return number - 1
        c, level = at
        low = counts[rows, c] <= level
        share = min(cells - 1, max(1, round(cells * low.mean())))
        return (c, level, least.get(c, 0), most.get(c, 1 << 30), grow(rows[low], share, least, most | {c: level}), grow(rows[~low], cells - share, least | {c: level + 1}, most))

    return grow(np.arange(len(counts)), cells, {}, {}), number


def home(tree: tuple | int, counts: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    out = np.zeros(len(counts), np.int32)

    def go(node, rows):
        if isinstance(node, tuple):
            low = counts[rows, node[0]] <= node[1]
            go(node[4], rows[low])
            go(node[5], rows[~low])
        else:
            out[rows] = node

    go(tree, np.arange(len(counts)))
    return out


def reach(tree: tuple | int, counts: np.ndarray, add: int, take: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every cell whose box a row meets by adding and taking away so many letters at most; rows ascend."""
    rows_out, cells_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

    def go(node, rows, added, taken):
        if not len(rows):
            return
        if not isinstance(node, tuple):
            rows_out.append(rows)
            cells_out.append(np.full(len(rows), node, np.int32))
            return
        c, level, least, most, low, high = node
        q = counts[rows, c]
        more = taken + np.maximum(q - level, 0) - np.maximum(q - most, 0)
        go(low, rows[more <= take], added[more <= take], more[more <= take])
        more = added + np.maximum(level + 1 - q, 0) - np.maximum(least - q, 0)
        go(high, rows[more <= add], more[more <= add], taken[more <= add])

    none = np.zeros(len(counts), np.int64)
    go(tree, np.arange(len(counts)), none, none)
    rows, cells = np.concatenate(rows_out), np.concatenate(cells_out)
    order = np.lexsort((cells, rows))
    return rows[order], cells[order]


def _int_lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int32()))


def _route(shared):
    """Each word with its cell, the later cells of its length and the cells of the next length where near words may stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            lens = batch.column(0).to_numpy()
            for n in np.unique(lens).tolist():
                own = batch.take(pa.array(np.flatnonzero(lens == n)))
                step = max(1, PAGE_BYTES // n)
                for k in range(0, len(own), step):
                    part = own.slice(k, step)
                    counts = counts_of(codes_of(part.column(1).to_pylist(), n))
                    cell = home(trees.get(n, 0), counts)
                    rows, cells = reach(trees.get(n, 0), counts, 1, 1)
                    later = cells > cell[rows]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(cell), _int_lists(rows[later], cells[later], len(part)), _int_lists(*reach(trees.get(n + 1, 0), counts, 1, 0), len(part))], ["len", "word", "n", "cell", "same", "longer"])

    return run


class Classes:
    """Words of one length by their letter counts: word places sorted by class, the classes' bounds, their counts and codes."""

    def __init__(self, words: list[str], n: np.ndarray, length: int):
        self.words, self.n, self.length = words, n, length
        self.codes = codes_of(words, length)
        letters = np.sort(self.codes, axis=1)
        _, first, of = np.unique(letters.view([("", "V", length)]).ravel() if length else np.zeros(len(words)), return_index=True, return_inverse=True)
        self.order = np.argsort(of, kind="stable")
        self.bounds = np.append(np.searchsorted(of[self.order], np.arange(len(first))), len(words))
        self.counts = counts_of(self.codes[first])
        self.rank = np.empty(len(words), np.int64)
        self.rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
        padded = np.zeros((len(words), -(-length // 8) * 8), np.uint8)
        padded[:, :length] = self.codes
        self.eights = padded.view("<u8")


class Lower:
    """The lower part of a tree: nodes with tight boxes over the classes of a page, leaves of LEAF of them at most."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.root = self._grow(np.arange(len(counts)))

    def _grow(self, rows: np.ndarray) -> tuple:
        own = self.counts[rows]
        at = halves(own) if len(rows) > LEAF else None
        box = own.min(axis=0), own.max(axis=0)
        if at is None:
            return (*box, rows)
        low = own[:, at[0]] <= at[1]
        return (*box, self._grow(rows[low]), self._grow(rows[~low]))

    def search(self, queries: np.ndarray, add: int, take: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, class) of all that differ by exactly so many letters added and taken away."""
        size = queries.sum(axis=1)
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, rows = stack.pop()
            q = queries[rows]
            near = (np.maximum(node[0] - q, 0).sum(axis=1) <= add) & (np.maximum(q - node[1], 0).sum(axis=1) <= take)
            rows = rows[near]
            if not len(rows):
                continue
            if len(node) == 4:
                stack += [(node[2], rows), (node[3], rows)]
                continue
            for k in range(0, len(rows), 4096):
                some = rows[k : k + 4096]
                i, j = np.nonzero(shared_letters(queries[some], self.counts[node[2]]) == (size[some] - take)[:, None])
                yield some[i], node[2][j]


def shared_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters each row of a and of b have in common, repeats included."""
    most = np.minimum(a.max(axis=0), b.max(axis=0))
    if int(most.sum()) <= LEVELS:
        # a count as so many ones: the common ones are a product
        letter = np.repeat(np.arange(a.shape[1]), most)
        level = np.arange(len(letter)) - np.repeat(np.cumsum(most) - most, most) + 1
        return ((a[:, letter] >= level).astype(np.float32) @ (b[:, letter] >= level).astype(np.float32).T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for c in np.flatnonzero(most).tolist():
        out += np.minimum(a[:, c][:, None], b[:, c])
    return out


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of eight letters each that differ in exactly one letter."""
    different = np.zeros(len(a), np.int64)
    for c in range(a.shape[1]):
        x = a[:, c] ^ b[:, c]
        for shift in (4, 2, 1):
            x |= x >> np.uint64(shift)
        different += ((x & np.uint64(0x0101010101010101)) * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)
    return different == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of letters where b is a with one more letter."""
    front = np.minimum.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.minimum.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


def near_words(queries: Classes, members: Classes, lower: Lower, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in queries, place in members) of the near words; own: the queries are the members, each pair once."""
    longer = members.length - queries.length
    for a, b in lower.search(queries.counts, 1, 1 - longer):
        if own:
            a, b = a[a < b], b[a < b]
        times = np.diff(members.bounds)[b]
        pairs = np.diff(queries.bounds)[a] * times
        upto = np.cumsum(pairs)
        done, total = 0, int(upto[-1]) if len(upto) else 0
        while done < total:
            at = np.arange(done, min(total, done + max(1, CHUNK // (2 * members.length))))
            done = int(at[-1]) + 1
            k = np.searchsorted(upto, at, "right")
            left, right = np.divmod(at - (upto[k] - pairs[k]), times[k])
            i, j = queries.order[queries.bounds[a[k]] + left], members.order[members.bounds[b[k]] + right]
            fine = one_inserted(queries.codes[i], members.codes[j]) if longer else one_replaced(queries.eights[i], members.eights[j])
            yield i[fine], j[fine]


def summed(of: Classes, near: Classes, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """For each word of `of` among the pairs: its near words' number, and the one with the largest n, ties to the smallest."""
    order = np.lexsort((near.rank[j], -near.n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    best = j[first]
    words = [pa.array([c.words[k] for k in at.tolist()], pa.string()) for c, at in ((of, i[first]), (near, best))]
    return pa.RecordBatch.from_arrays([words[0], pa.array(np.diff(np.append(first, len(i)))), pa.array(near.n[best]), words[1]], ["word", "near", "best_n", "best"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (len, cell, part, role, word, n) sorted by the first four: a page's words (role 0), then its queries (1: of its length, 2: one shorter)."""

    def found(queries: Classes, members: Classes, lower: Lower, own: bool) -> Iterator[pa.RecordBatch]:
        pairs = list(near_words(queries, members, lower, own))
        i, j = (np.concatenate([p[side] for p in pairs]) if pairs else np.zeros(0, np.int64) for side in (0, 1))
        if len(i) and own:
            yield summed(members, members, np.concatenate([i, j]), np.concatenate([j, i]))
        elif len(i):
            yield summed(queries, members, i, j)
            yield summed(members, queries, j, i)

    key, words, counts = None, [], []
    page: tuple[Classes, Lower] | None = None

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal page
        if page is None and words:
            members = Classes(words, np.concatenate(counts), key[0])
            page = members, Lower(members.counts)
            yield from found(members, *page, own=True)

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in range(4)]
        new = np.ones(len(batch), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cuts = np.flatnonzero(new).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
            at, role = tuple(int(c[a]) for c in columns[:3]), int(columns[3][a])
            if at != key:
                yield from settle()
                key, words, counts, page = at, [], [], None
            own, n = batch.column(4).slice(a, b - a).to_pylist(), batch.column(5).slice(a, b - a).to_numpy()
            if role == 0:
                words += own
                counts.append(n)
                continue
            yield from settle()
            if page is not None:
                length = at[0] - (role == 2)
                step = max(1, PAGE_BYTES // length)
                for k in range(0, len(own), step):
                    yield from found(Classes(own[k : k + step], n[k : k + step], length), *page, own=False)
    yield from settle()


def neighbours(words: DataFrame, sample: int = SAMPLE, page: int = PAGE) -> DataFrame:
    """(word, near, best_n, best) of the words (word, n) that have near words: their number and the one with the largest n."""
    spark = words.sparkSession
    words = words.select(F.length("word").alias("len"), "word", "n")
    sizes = {r[0]: r[1] for r in words.groupBy("len").agg(F.count("*")).collect()}  # a row a length
    every = max(1, sum(sizes.values()) // sample)
    some: dict[int, list[str]] = {}
    for n, w in words.where((F.length("word") <= 1 << 10) & (F.pmod(F.xxhash64("word"), F.lit(every)) == 0)).select("len", "word").toLocalIterator():
        some.setdefault(n, []).append(w)
    trees = {n: upper_tree(counts_of(codes_of(own, n)), min(-(-sizes[n] // page), 1 + len(own) // 4))[0] for n, own in some.items()}
    routed = cut(words.mapInArrow(_route(spark.sparkContext.broadcast(trees)), _ROUTED), "routed")
    pages = routed.groupBy("len", "cell").agg(F.greatest(F.ceil(F.count("*") / page), F.ceil(F.sum("len") / PAGE_BYTES)).cast("int").alias("parts"))
    pages = cut(pages, "pages")
    pages = broadcast_if_small(pages, pages.count(), 100_000)
    key = ["len", "cell"]
    placed = routed.join(pages, key).withColumn("part", F.expr("cast(pmod(xxhash64(word), parts) as int)"))
    members = placed.select("len", "cell", "part", F.lit(0).alias("role"), "word", "n")
    # the later parts of a word's own cell, all parts of the other cells
    own = placed.where("part < parts - 1").select("len", "cell", F.explode(F.expr("sequence(part + 1, parts - 1)")).alias("part"), F.lit(1).alias("role"), "word", "n")
    same = routed.select("len", F.explode("same").alias("cell"), F.lit(1).alias("role"), "word", "n")
    longer = routed.select((F.col("len") + 1).alias("len"), F.explode("longer").alias("cell"), F.lit(2).alias("role"), "word", "n")
    others = same.unionByName(longer).join(pages, key).select("len", "cell", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "role", "word", "n")
    dealt = members.unionByName(own).unionByName(others).repartition("len", "cell", "part").sortWithinPartitions("len", "cell", "part", "role")
    found = dealt.mapInArrow(_search, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("down"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("x")).select("word", "near", (-F.col("x.down")).alias("best_n"), "x.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last form that each word leads to, by pointer doubling."""
    links = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not links.where("moved").isEmpty():
        a, b = links.alias("a"), links.select(F.col("word").alias("at"), F.col("root").alias("next")).alias("b")
        links = cut(a.join(b, F.col("a.root") == F.col("b.at"), "left").select("a.word", F.coalesce("b.next", "a.root").alias("root"), F.col("b.next").isNotNull().alias("moved")), "roots")
    return links.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 3, ratio: int = 2, every: int = 97, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts with at least `least` occurrences and `shortest` letters."""
    words = cut(typed_words(docs, every, id_col, text_col, shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least), "words")
    near = neighbours(words)
    form = F.col("best_n") >= ratio * F.col("n")
    known = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")), "forms")
    led = roots(known.where("form is not null"))
    return known.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
