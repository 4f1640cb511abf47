"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Every source has a token target. The document rates w minimise the entropy sum m(w) over rates from 0 to 2 with base
measure m = sqrt(size) subject to `sum of rate * size = target` for each source. The dual is convex with one
multiplier a source, and its solution tilts the rates exponentially: w = 2 / (1 + exp(-lambda * sqrt(size / mean))).
Newton steps, kept in a shrinking bracket, solve all sources at once; each step is one aggregate over the distinct
(source, size) pairs with their counts. Rates become 0, 1 or 2 copies by a seeded hash of the row; the offset of that
rounding is then set so that the source's words meet its target to within about one document.

Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating. Targets stop at `cap` times the source's
size and the excess goes to the others by weight. Null texts have size 0 and are never taken. Empty input gives no
rows. Rows that are equal in source, id and text are numbered, and their hashes spread evenly, so that each has a step
of its own; the numbering is written once and dealt by the partitions that the rows were read in. Columns of docs with
the name of one of the five made here are replaced; all others pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import WORD, cut, own_columns, quoted

WEIGHTS = (5.0, 2.0, 1.0)
#: The bracket halves where a Newton step leaves it, so this many suffice for any target that can be met.
STEPS = 60
#: Newton steps between two written tables.
STRIDE = 5
BINS = 4096
MADE = ("__size", "__source_size", "__target", "__rate", "__copies")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with weight and target: weighted shares of share * all words, none above cap * source_size."""
    # one row a source from here on
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    w = w.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    w = w.withColumn("level", level)
    # the first source in this order that its own level does not fill sets the level of all that follow
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(whole)
    w = w.withColumn("final", F.coalesce(final["level"], F.lit(float("inf"))))
    return w.select("source", "source_size", "weight", F.least("limit", F.col("final") * F.col("weight")).alias("target"))


def _rate(z: str, lam: str, cap: float) -> Column:
    return F.lit(cap) / (1 + F.exp(-F.col(lam) * F.col(z)))


def balance(groups: DataFrame, goal: DataFrame, cap: float = 2.0, steps: int = STEPS) -> DataFrame:
    """(source, lam, mean) that solves sum n * size * rate = target for groups (source, size, n) and goal (source, target)."""
    mean = groups.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = (
        goal.where("source_size > 0")
        .join(mean, goal["source"].eqNullSafe(mean["source"]))
        .select(goal["source"], "target", "source_size", "mean", F.lit(0.0).alias("lam"), F.lit(-1e3).alias("low"), F.lit(1e3).alias("high"))
    )
    state = cut(state, "dual")
    for step in range(steps):
        s = state.alias("s")
        x = groups.where("size > 0").alias("g").join(s, F.expr("g.source <=> s.source")).select("s.*", "g.size", "g.n", F.sqrt(F.col("g.size") / F.col("s.mean")).alias("z"))
        r = _rate("z", "lam", cap)
        words = F.col("n") * F.col("size")
        sums = x.groupBy("source", "target", "source_size", "mean", "lam", "low", "high").agg(
            F.sum(words * r).alias("f"), F.sum(words * F.col("z") * r * (1 - r / cap)).alias("slope")
        )
        gap = F.col("f") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 1e-12) & (newton > low) & (newton < high)
        bounded = F.when(inside, newton).otherwise(F.when((low < -999) | (high > 999), F.col("lam") + F.when(gap < 0, 4.0).otherwise(-4.0)).otherwise((low + high) / 2))
        state = sums.select("source", "target", "source_size", "mean", F.when(gap == 0, F.col("lam")).otherwise(F.greatest(F.lit(-1e3), F.least(F.lit(1e3), bounded))).alias("lam"), low.alias("low"), high.alias("high"), (F.abs(gap) <= 1e-9 * F.col("target")).alias("met"))
        if (step + 1) % STRIDE == 0 or step == steps - 1:
            state = cut(state, "dual")
            if state.where("not met").isEmpty():
                break
    return state.select("source", "lam", "mean")


def _uniform(key: Column, digest: Column, seed: int) -> Column:
    return (F.pmod(F.xxhash64(key, digest, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _spread(u: Column) -> Column:
    """The hash u of the n-th of m equal rows, moved on by its share of the whole."""
    at = u + (F.col("n") - 1) / F.col("m")
    return at - F.floor(at)


def number_repeats(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """Rows (row, source, id, digest, size) with n of m: their number among the equal ones listed in repeats (source, id, digest, size, m).

    A class is numbered in parts, one for each partition of the input, so that no task gets it whole.
    """
    same = F.expr("a.source <=> b.source and a.id <=> b.id and a.digest = b.digest")
    single = rows.alias("a").join(repeats.alias("b"), same, "left_anti").select("a.*", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("m"))
    several = cut(rows.withColumn("part", F.spark_partition_id()).alias("a").join(repeats.alias("b"), same).select("a.*", "b.m", F.xxhash64("a.row").alias("order")), "several")
    key = ["source", "id", "digest"]
    sizes = several.groupBy(*key, "part").agg(F.count("*").alias("k"))
    sizes = sizes.withColumn("before", F.sum("k").over(Window.partitionBy(*key).orderBy("part")) - F.col("k"))
    numbered = several.withColumn("i", F.row_number().over(Window.partitionBy(*key, "part").orderBy("order")))
    on = F.expr("a.source <=> b.source and a.id <=> b.id and a.digest = b.digest and a.part = b.part")
    numbered = numbered.alias("a").join(sizes.alias("b"), on).select("a.row", "a.source", "a.id", "a.digest", "a.size", (F.col("b.before") + F.col("a.i")).alias("n"), "a.m")
    return single.unionByName(numbered)


def mix_sources(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[float, ...] = WEIGHTS, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", seed: int = 8) -> DataFrame:
    """All rows and columns of docs with __size, __source_size, __target, __rate and __copies."""
    kept = quoted(own_columns(docs, MADE))
    # one row a document without its text: the words are counted once for all that follows but the result
    key, digest = F.col(id_col), F.xxhash64(F.col(text_col))
    sized = cut(docs.select(F.col(source_col).alias("source"), key.alias("id"), digest.alias("digest"), word_count(text_col).alias("size")), "sized")
    groups = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    per_source = groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = cut(targets(per_source, share, cap, weights), "targets")
    dual = balance(groups, goal, float(cap))
    plan = cut(goal.alias("a").join(dual.alias("b"), F.expr("a.source <=> b.source"), "left").select("a.source", "a.source_size", "a.target", "b.lam", "b.mean"), "plan")
    # a rate r becomes floor(r + u): u is a hash of the row, shifted by the source's offset
    u = _uniform(F.col("id"), F.col("digest"), seed)
    rate = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap))).otherwise(F.coalesce(_rate("z", "lam", float(cap)), F.lit(0.0)))
    repeats = cut(sized.groupBy("source", "id", "digest", "size").agg(F.count("*").alias("m")).where("m > 1"), "repeats")
    repeated = not repeats.isEmpty()
    numbers = sized.withColumn("n", F.lit(1)).withColumn("m", F.lit(1))
    if repeated:
        several = repeats.withColumn("c", F.explode(F.expr(f"sequence(0L, (m - 1) div {BINS})"))).repartition("id", "digest", "c")
        several = several.withColumn("n", F.explode(F.expr(f"sequence(c * {BINS} + 1, least(m, (c + 1) * {BINS}))"))).drop("c")
        single = sized.alias("a").join(repeats.alias("b"), F.expr("a.source <=> b.source and a.id <=> b.id and a.digest = b.digest"), "left_anti")
        numbers = single.select("a.*", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("m")).unionByName(several)
    slim = (
        numbers.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source"))
        .withColumn("z", F.sqrt(F.col("size") / F.col("mean")))
        .select("d.*", "p.target", "p.source_size", rate.alias("rate"), _spread(u).alias("u"))
    )
    # copies at offset t: floor(rate + u + t - 1/2); the steps are where a copy more is taken
    edge = F.explode(F.transform(F.sequence(F.lit(1), F.lit(int(cap))), lambda k: k - (F.col("rate") + F.col("u"))))
    jumps = slim.where("size > 0 and rate > 0 and rate < %d" % cap).select("source", "size", "target", edge.alias("t"))
    coarse = jumps.groupBy("source", F.floor((F.col("t") + 2) * BINS).alias("bin")).agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    coarse = cut(coarse.withColumn("upto", run), "bins")
    at = coarse.where("upto - words < target").groupBy("source").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("before")), "bin").alias("x")).select("source", "x.bin", "x.before")
    within = jumps.alias("j").join(at.alias("k"), F.expr("j.source <=> k.source and floor((j.t + 2) * %d) = k.bin" % BINS)).select("j.source", "j.size", "j.t", "j.target", "k.bin", "k.before")
    fine = within.groupBy("source", F.floor((F.col("t") + 2) * BINS * BINS * 16).alias("fine")).agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("before").alias("before"))
    total = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("fine"))
    ends = fine.withColumn("total", total).select("source", "target", F.explode(F.array(F.struct("fine", "total"), F.struct((F.col("fine") - 1).alias("fine"), (F.col("total") - F.col("words")).alias("total")))).alias("x"))
    best = ends.groupBy("source").agg(F.min_by("x.fine", F.struct(F.abs(F.col("x.total") - F.col("target")), "x.fine")).alias("fine"))
    plan = cut(plan.alias("p").join(best.alias("f"), F.expr("p.source <=> f.source"), "left").select("p.*", "f.fine"), "offsets")
    step = F.col("rate") + _spread(_uniform(F.col("id"), F.col("digest"), seed))
    taken = F.expr("0")
    for k in range(1, int(cap) + 1):
        taken = taken + (F.floor((k - step + 2) * BINS * BINS * 16) <= F.col("fine")).cast("int")
    copies = F.when(F.col("size") == 0, 0).when(F.col("rate") >= cap, int(cap)).otherwise(F.coalesce(taken, F.lit(0)))
    rows = docs.select(F.struct(*kept).alias("row"), F.col(source_col).alias("source"), key.alias("id"), digest.alias("digest"), word_count(text_col).alias("size"))
    rows = number_repeats(rows, repeats) if repeated else rows.withColumn("n", F.lit(1)).withColumn("m", F.lit(1))
    out = (
        rows.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source"))
        .withColumn("z", F.sqrt(F.col("size") / F.col("mean")))
        .select("d.*", "p.source_size", "p.target", rate.alias("rate"), "p.fine")
    )
    made = [F.col("size"), F.col("source_size"), F.col("target"), F.col("rate"), copies.cast("int")]
    return out.select("row.*", *[c.alias(name) for c, name in zip(made, MADE, strict=True)])
