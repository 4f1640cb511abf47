"""Text functions of the library as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of metrics.
METRIC_ALIASES = {
    "gm": "gross_margin",
    "gpm": "gross_margin",
    "gross_margin_percent": "gross_margin",
    "op_margin": "operating_margin",
    "operating_margin_percent": "operating_margin",
    "rev": "revenue",
    "sales": "revenue",
    "yoy_growth": "growth_yoy",
    "y_y_growth": "growth_yoy",
}

#: Units and their other names, in the order in which they are tried.
UNIT_ALIASES = {
    "pct": ("%", "pct", "percent", "percentage"),
    "x": ("x", "turn", "turns"),
    "usd_bn": ("usd bn", "us$ bn", "$ bn", "usd billion"),
    "usd_m": ("usd m", "usd mm", "us$ m", "$ m", "usd million"),
    "jpy_m": ("jpy m", "¥ m", "jpy million"),
    "cny_bn": ("cny bn", "rmb bn", "cn¥ bn", "cny billion"),
    "cny_m": ("cny m", "rmb m", "cn¥ m", "cny million"),
    "usd": ("usd", "us$", "$"),
    "jpy": ("jpy", "¥"),
    "cny": ("cny", "rmb", "cn¥"),
    "eur": ("eur", "€"),
    "gbp": ("gbp", "£"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """ceil(CJK characters / 1.5 + other characters / 4)."""
    cjk = F.length(F.regexp_replace(text, r"[^一-鿿　-ヿ＀-￯]", ""))
    return F.ceil(cjk / 1.5 + (F.length(text) - cjk) / 4)


def plain(text: Column) -> Column:
    """Text without links' brackets, emphasis, code marks and tags, trimmed."""
    for pattern, to in ((r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"), ("`([^`]+)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), ("<[^>]+>", "")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def visible(text: Column) -> Column:
    """Text as a reader sees it: no comments, links by their labels, white space collapsed."""
    for pattern, to in ((r"(?s)<!--.*?-->", " "), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"[#>*`|-]", " "), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def metric_key(text: Column) -> Column:
    """The metric's key: no bracketed ending, words joined by _, other names resolved; null without ASCII letters or digits."""
    raw = F.lower(F.trim(F.regexp_replace(plain(text), r"\(([^)]+)\)\s*$", "")))
    raw = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "&", " and "), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    aliases = F.create_map(*[F.lit(x) for p in METRIC_ALIASES.items() for x in p])
    return let(raw, lambda k: F.when(k == "", None).otherwise(F.coalesce(F.try_element_at(aliases, k), k)))


def unit_key(text: Column) -> Column:
    """The unit: its own name, else the first whose other name equals or lies within the text, else the text as a key."""
    low = F.trim(F.regexp_replace(F.lower(plain(text)), r"\s+", " "))

    def named(low: Column) -> Column:
        out = F.nullif(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9_]+", "_"), "^_+|_+$", ""), F.lit(""))
        for unit, names in reversed(UNIT_ALIASES.items()):
            fits = F.lit(False)
            for n in names:
                fits = fits | low.contains(n)
            out = F.when(fits, unit).otherwise(out)
        return F.when(low == "", None).when(low.isin(*UNIT_ALIASES), low).otherwise(out)

    return let(low, named)


def period_key(text: Column) -> Column:
    """FY26E to FY2026E, 1q26a to 1Q2026A, h126e to H12026E, current and ttm, ltm, ntm in their fixed forms; others as they are."""
    def named(t: Column) -> Column:
        up, low = F.upper(t), F.lower(t)
        return (
            F.when(t == "", None)
            .when(low == "current", "current")
            .when(low.isin("ttm", "ltm", "ntm"), up)
            .when(t.rlike(r"(?i)^(fy)?\d{2}[ae]$"), F.concat(F.lit("FY20"), F.regexp_replace(up, "^FY", "")))
            .when(t.rlike(r"(?i)^([1-4]q|h[12])\d{2}[ae]$"), F.concat(F.substring(up, 1, 2), F.lit("20"), F.substring(up, 3, 3)))
            .otherwise(t)
        )

    return let(plain(text), named)


_CURRENCY = r"(?i)^\s*(USD|US\$|\$|JPY|¥|CNY|RMB|CN¥|EUR|€|GBP|£)\s*"
_SCALE = r"(?i)\s*(bn|billion|b|mm|million|m|k|x)\s*$"


def value_cell(cell: Column) -> Column:
    """struct(numeric, text, unit) of a table cell; null for an empty or absent value. The scale names the unit and does not multiply."""
    def parted(t: Column) -> Column:
        bare = F.regexp_replace(t, "%", "")
        rest = F.regexp_replace(bare, _CURRENCY, "")
        return F.struct(
            t.alias("t"), F.lower(F.regexp_extract(bare, _CURRENCY, 1)).alias("currency"), F.lower(F.regexp_extract(rest, _SCALE, 1)).alias("scale"),
            F.trim(F.regexp_replace(F.regexp_replace(rest, _SCALE, ""), ",", "")).alias("number"),
        )

    def judged(p: Column) -> Column:
        t, currency, scale, number = p["t"], p["currency"], p["scale"], p["number"]
        is_number = number.rlike(r"^[+-]?\d*\.?\d+$")
        big, mid = scale.isin("bn", "b", "billion"), scale.isin("m", "mm", "million")
        usd, jpy, cny = currency.isin("$", "usd", "us$"), currency.isin("¥", "jpy"), currency.isin("cny", "rmb", "cn¥")
        inferred = (
            F.when(scale == "x", "x")
            .when(usd, F.when(mid, "usd_m").when(big, "usd_bn").otherwise("usd"))
            .when(jpy, F.when(mid, "jpy_m").otherwise("jpy"))
            .when(cny, F.when(big, "cny_bn").when(mid, "cny_m").otherwise("cny"))
            .when(currency.isin("€", "eur"), "eur")
            .when(currency.isin("£", "gbp"), "gbp")
        )
        unit = F.when(t.contains("%"), "pct").when(is_number, inferred)
        value = F.struct(F.when(is_number, F.expr("0D") + number.try_cast("double")).alias("numeric"), F.when(~is_number, t).alias("text"), unit.alias("unit"))
        return F.when((t == "") | t.rlike(r"(?i)^(-|n/a|na|nm|none)$"), None).otherwise(value)

    return let(let(plain(cell), parted), judged)


def fact_value(value: Column, metric: Column, unit: Column) -> Column:
    """struct(numeric, text): qualified values stay text; shares above 1.5 of margins, rates and percentages are divided by 100."""
    t = F.trim(value)
    number = F.regexp_replace(t, ",", "").try_cast("double")
    qualified = t.rlike(r"[<>≤≥~≈+]|\d\s*[-–—]\s*\d")
    share = (metric.endswith("_margin") | metric.endswith("_rate") | metric.endswith("_pct") | F.coalesce(unit == "pct", F.lit(False))) & (number > 1.5)
    return F.struct(F.when(~qualified, F.when(share, number / 100).otherwise(number)).alias("numeric"), F.when(qualified | number.isNull(), t).alias("text"))


def wikilinks(content: Column) -> Column:
    """All [[dir/name#part|label]] targets as they are written."""
    return F.regexp_extract_all(content, F.lit(r"\[\[((?:companies|industries|concepts|sources|theses|briefs|outputs)/[^\]|#]+)"), 1)
