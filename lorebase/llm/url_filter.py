"""URL filter: rules first, a character language-model ratio for the rest; DataFrame operations only.

Urls that a rule accepts or rejects teach two smoothed variable-order Markov models over characters (contexts of up
to three, Witten-Bell interpolation down to single characters). A url's score is the mean log-likelihood difference
of its characters; the threshold is calibrated on the ruled urls, between the classes' means, nearer to the class
with the smaller spread.

Characters are folded to 39 symbols, so there are at most 39^4 n-grams; they are counted before any shuffle carries
them. The table of n-gram log ratios is broadcast when it has at most BROADCAST_GRAMS rows, else shuffled. Each
distinct url is scored once.

A rule is read as host, `/`, path: its path begins with `/`, so a url without a path (`http://x.net`) fits no rule.

Null urls and urls without `://` have an empty host and path, fit no rule and are judged by their characters, none
here: an empty url has only the end sign. Without examples of both classes everything unruled is allowed. Repeated
rows each keep their row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import broadcast_if_small, cut

ORDER = 3
SYMBOLS = 39
BROADCAST_GRAMS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: len(x[1])):  # the longest comes last and is tested first
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _folded(url: Column) -> Column:
    x = F.translate(F.coalesce(url, F.lit("")), _UPPER + "0123456789", _LOWER + "0" * 10)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(x, r"[^a-z0./\-_?&=#:%]", "~"), F.lit("$"))


def _grams(urls: DataFrame) -> DataFrame:
    """Every character with its context of three."""
    places = F.sequence(F.lit(1), F.length("folded") - ORDER)
    return urls.withColumn("gram", F.explode(F.transform(places, lambda i: F.substring(F.col("folded"), i, F.lit(ORDER + 1)))))


def _log_ratios(seen: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, ratio): log P_allow - log P_block of the last character in its context, for each gram of `seen`."""
    both = counts.groupBy("gram").agg(F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("allow"), F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("block"))
    both = cut(both, "grams")
    out = seen
    for k in range(ORDER + 1):  # k characters of context
        own = F.substring("gram", ORDER + 1 - k, k + 1)
        n = both.groupBy(own.alias(f"g{k}")).agg(F.sum("allow").alias(f"allow{k}"), F.sum("block").alias(f"block{k}"))
        context = F.substring(f"g{k}", 1, k) if k else F.lit("")
        c = n.groupBy(context.alias(f"c{k}")).agg(
            *[x for w in ("allow", "block") for x in (F.sum(f"{w}{k}").alias(f"{w}_all{k}"), F.count_if(F.col(f"{w}{k}") > 0).alias(f"{w}_kinds{k}"))]
        )
        out = out.withColumn(f"g{k}", own).withColumn(f"c{k}", context).join(n, f"g{k}", "left").join(c, f"c{k}", "left")
    ratio = F.lit(0.0)
    for w, sign in (("allow", 1), ("block", -1)):
        v = lambda name, k, w=w: F.coalesce(F.col(f"{w}{name}{k}"), F.lit(0)).cast("double")
        p = (v("", 0) + 0.5) / (v("_all", 0) + 0.5 * SYMBOLS)
        for k in range(1, ORDER + 1):
            whole = v("_all", k) + v("_kinds", k)
            p = F.when(whole > 0, (v("", k) + v("_kinds", k) * p) / whole).otherwise(p)
        ratio = ratio + sign * F.log(p)
    return out.select("gram", ratio.alias("ratio"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of every row."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("label", verdict).withColumn("key", F.coalesce("url", F.lit("")))
    distinct = rows.groupBy("key", "label").agg(F.count("*").alias("rows")).withColumn("folded", _folded(F.col("key")))
    distinct = cut(distinct, "urls")
    counts = _grams(distinct.where("label is not null")).groupBy("label", "gram").agg(F.count("*").alias("n"))
    seen = cut(_grams(distinct).select("gram").distinct(), "seen")
    ratios = cut(_log_ratios(seen, counts), "ratios")
    table = broadcast_if_small(ratios, ratios.count(), BROADCAST_GRAMS)
    scored = _grams(distinct.select("key", "label", "rows", "folded")).join(table, "gram").groupBy("key", "label", "rows").agg(F.avg("ratio").alias("score"))
    scored = cut(scored, "scores")
    by = {w: (F.avg(F.when(F.col("label") == w, F.col("score"))), F.coalesce(F.stddev_pop(F.when(F.col("label") == w, F.col("score"))), F.lit(0.0)) + 1e-9) for w in ("allow", "block")}
    threshold = scored.agg(((by["allow"][0] * by["block"][1] + by["block"][0] * by["allow"][1]) / (by["allow"][1] + by["block"][1])).alias("threshold"))
    out = rows.join(scored.select("key", "score"), "key", "left").withColumn("threshold", threshold.scalar())
    method = F.when(F.col("score") < F.col("threshold"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "score", "threshold")
