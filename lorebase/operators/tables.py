"""HTML tables of documents as cells, bundles, markdown, and the facts they hold."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import text as t

#: Names of header cells, by what their column holds.
HEADER_ALIASES = {
    "entity": ("entity", "company", "target", "subject", "ticker", "slug", "公司", "公司名称", "股票", "股票代码", "标的", "名称"),
    "metric": ("metric", "item", "kpi", "指标", "项目", "科目", "内容"),
    "period": ("period", "quarter", "timeframe", "date", "fiscal_period", "期间", "季度", "财年", "日期"),
    "value": ("value", "data", "figure", "amount", "result", "number", "数值", "数据", "金额", "数字"),
    "unit": ("unit", "currency", "multiple", "单位", "货币"),
}

#: Forms of header cells that name a period (case does not matter).
PERIOD_HEADERS = (
    r"^(current|ttm|ltm|ntm|fy\d{2,4}[ae]?|[1-4]q\d{2,4}[ae]?|h[12]\d{2,4}[ae]?|\d{4}-\d{2}-\d{2}|\d{4}[ae]?)$",
    r"^\d{2,4}年(预期|实际|目标)?(?:[\x{4e00}-\x{9fff}]+)?$",
    r"^\d{2,4}(?:Q[1-4]|H[12]|PE|EV|EPS)?$",
    r"^FY?\d{2,4}(?:[ae]|下半年|上半年)?$",
)

_ROW, _CELL = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.I | re.S), re.compile(r"<t[dh]\b([^>]*)>(.*?)</t[dh]>", re.I | re.S)


def _span(attributes: str, name: str) -> int:
    found = re.search(rf'{name}\s*=\s*"?(\d+)', attributes, re.I)
    return max(1, int(found[1])) if found else 1


#: Columns that one cell may span, as in browsers.
MOST_COLUMNS = 1000


def grid(markup: str) -> list[list[str]]:
    """The cells of an HTML table by row and column: a spanning cell fills all its places, short rows end in empty cells.

    As in browsers a cell spans no more rows than the table has left, and MOST_COLUMNS columns at most.
    """
    bodies = _ROW.findall(markup)
    rows: list[dict[int, str]] = [{} for _ in bodies]
    for r, body in enumerate(bodies):
        c = 0
        for attributes, inner in _CELL.findall(body):
            while c in rows[r]:
                c += 1
            text = re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", " ", inner))).strip()
            right = min(_span(attributes, "colspan"), MOST_COLUMNS)
            for row in rows[r : r + _span(attributes, "rowspan")]:
                row.update((j, text) for j in range(c, c + right))
            c += right
    wide = max((1 + max(row) for row in rows if row), default=0)
    return [[row.get(j, "") for j in range(wide)] for row in rows]


def extract_tables(blocks: DataFrame) -> DataFrame:
    """(doc_id, table_id, headers, rows) of the table blocks with cells: the first row heads the others.

    table_id counts all table blocks of the document, t1 first, so tables without cells leave gaps.
    """
    order = Window.partitionBy("doc_id").orderBy("page_idx", "block_idx")
    found = blocks.where("type = 'table'").select("doc_id", F.concat(F.lit("t"), F.row_number().over(order)).alias("table_id"), F.coalesce("html", F.lit("")).alias("html"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["grid"] = [grid(x) for x in f["html"]]
            f = f[[len(g) > 0 and len(g[0]) > 0 for g in f["grid"]]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "table_id": f["table_id"], "headers": [g[0] for g in f["grid"]], "rows": [g[1:] for g in f["grid"]]})

    return found.mapInPandas(run, "doc_id long, table_id string, headers array<string>, rows array<array<string>>")


def _line(cells: Column) -> Column:
    escaped = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), r"\n+", " ")))
    return F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))


def table_markdown(tables: DataFrame) -> DataFrame:
    """Tables with raw_markdown and row_markdowns, row_count and column_count."""
    lines = F.transform("rows", _line)
    rule = F.concat(F.lit("| "), F.array_join(F.transform("headers", lambda _: F.lit("---")), " | "), F.lit(" |"))
    return tables.select("*", F.size("rows").alias("row_count"), F.size("headers").alias("column_count"), F.array_join(F.concat(F.array(_line(F.col("headers")), rule), lines), "\n").alias("raw_markdown"), lines.alias("row_markdowns"))


def table_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, table_id, row_index, column_index, cell); the header row is row -1."""
    rows = tables.select("doc_id", "table_id", F.posexplode(F.concat(F.array("headers"), F.col("rows"))).alias("r", "cells"))
    return rows.select("doc_id", "table_id", (F.col("r") - 1).alias("row_index"), F.posexplode("cells").alias("column_index", "cell"))


def table_artifact(tables: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tables of the wanted (doc_id, table_id); a null table_id asks for all of the document."""
    w = wanted.select("doc_id", F.col("table_id").alias("asked")).distinct()
    return tables.join(w, "doc_id").where("asked IS NULL OR asked = table_id").drop("asked").dropDuplicates(["doc_id", "table_id"])


def header_key(header: Column) -> Column:
    """A header cell without marks, in lower case, words and Chinese characters joined by _."""
    key = F.regexp_replace(F.regexp_replace(F.lower(t.plain(header)), "[%/()]+", " "), r"[^a-z0-9\x{3400}-\x{9fff}]+", "_")
    return F.regexp_replace(key, "^_+|_+$", "")


def period_like(header: Column) -> Column:
    return t.let(t.plain(header), lambda h: h.rlike("(?i)" + "|".join(f"(?:{p})" for p in PERIOD_HEADERS)))


def entity_of(cell: Column, fallback: Column) -> Column:
    """The one entity that a cell links or names by slug; the fallback if it names none; null for several."""
    links = F.regexp_extract_all(cell, F.lit(r"\[\[((?:companies|industries|concepts)/[^\]|]+)(?:\|[^\]]+)?\]\]"), 1)
    named = t.let(t.plain(cell), lambda bare: F.when(bare.rlike("^(companies|industries|concepts)/.+"), bare))
    return t.let(links, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))).otherwise(F.coalesce(named, F.when(F.size(x) == 0, fallback))))


def metric_unit(cell: Column) -> Column:
    """The unit in brackets at the end of a metric cell, else null."""
    inner = F.regexp_extract(t.plain(cell), r"\(([^)]+)\)\s*$", 1)
    return F.when(inner != "", t.unit_key(inner))


def _with_columns(tables: DataFrame) -> DataFrame:
    """Tables with the places (from 0, -1: none) of their entity, metric, period, value and unit columns."""
    keys = F.transform("headers", header_key)
    # the first column whose name is one of the aliases
    place = lambda kind: F.coalesce(F.array_min(F.filter(F.transform(keys, lambda k, i: F.when(k.isin(*HEADER_ALIASES[kind]), i)), lambda i: i.isNotNull())), F.lit(-1))
    return tables.select("*", *[place(k).alias(f"{k}_at") for k in HEADER_ALIASES])


def _fact_rows(placed: DataFrame, entities: DataFrame) -> DataFrame:
    """One row a body row: entity, metric and the metric's unit, where the first two are known."""
    rows = placed.join(entities.select("doc_id", F.col("entity").alias("page_entity")), "doc_id", "left").select("*", F.posexplode("rows").alias("row_index", "cells"))
    at = lambda k: F.when(F.col(f"{k}_at") >= 0, F.get("cells", F.col(f"{k}_at")))
    rows = rows.select("*", entity_of(F.coalesce(at("entity"), F.lit("")), F.col("page_entity")).alias("entity"), t.metric_key(at("metric")).alias("metric"), metric_unit(at("metric")).alias("metric_unit"))
    return rows.where("entity IS NOT NULL AND metric IS NOT NULL")


def _facts(rows: DataFrame, cell: Column, column: Column, period: Column, given_unit: Column, period_header: Column, own_header: Column) -> DataFrame:
    v = t.value_cell(cell)
    rows = rows.select("*", v.alias("v"), column.alias("column_index"), period.alias("period"), given_unit.alias("given"), period_header.alias("period_header"), own_header.alias("own_header")).where("v IS NOT NULL")
    percent = F.col("v.unit") == "pct"
    unit = F.when(percent, "pct").otherwise(F.coalesce("given", "v.unit"))
    metric_header = F.get("headers", F.col("metric_at"))
    return rows.select(
        "doc_id", "table_id", "row_index", "column_index", "entity", "metric", "period", F.col("v.numeric").alias("value_numeric"), F.col("v.text").alias("value_text"), unit.alias("unit"),
        F.concat(F.lit("r"), "row_index", F.lit("c"), "column_index").alias("cell_ref"), "period_header", metric_header.alias("metric_header"),
        F.array_join(F.filter(F.array(metric_header, F.col("own_header")), lambda x: x != ""), " > ").alias("header_path"), F.element_at("row_markdowns", F.col("row_index") + 1).alias("source_quote"),
    )


def facts_from_explicit_tables(tables: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts of tables with metric and value columns; entities (doc_id, entity) stand in where a row names none."""
    rows = _fact_rows(_with_columns(table_markdown(tables)).where("metric_at >= 0 AND value_at >= 0"), entities)
    period = F.when(F.col("period_at") >= 0, t.period_key(F.get("cells", F.col("period_at"))))
    unit = F.coalesce(F.when(F.col("unit_at") >= 0, t.unit_key(F.get("cells", F.col("unit_at")))), F.col("metric_unit"))
    head = lambda k: F.when(F.col(f"{k}_at") >= 0, F.get("headers", F.col(f"{k}_at")))
    return _facts(rows, F.get("cells", F.col("value_at")), F.col("value_at"), period, unit, head("period"), head("value"))


def facts_from_matrix_tables(tables: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts of tables with a metric column, columns of periods and no value column: one a row and period."""
    rows = _fact_rows(_with_columns(table_markdown(tables)).where("metric_at >= 0 AND value_at < 0"), entities)
    wide = rows.select("*", F.posexplode("headers").alias("c", "head")).where((F.col("c") != F.col("metric_at")) & (F.col("c") != F.col("entity_at")) & (F.col("c") != F.col("unit_at")) & period_like(F.col("head")))
    unit = F.coalesce("metric_unit", F.when(F.col("unit_at") >= 0, t.unit_key(F.get("cells", F.col("unit_at")))))
    return _facts(wide, F.get("cells", F.col("c")), F.col("c"), t.period_key(F.col("head")), unit, F.col("head"), F.col("head"))
