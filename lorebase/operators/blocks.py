"""Documents as rows of blocks, and their chunks.

A block is (doc_id, page_idx, block_idx, type, level, text, items, html, caption, footnote) with items as
array<struct<ilevel, prefix, text>>. Documents are independent, so chunking packs each document's blocks in one place:
`collect_list` gathers a document, never more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_FIELDS = ("page_idx", "block_idx", "type", "level", "text", "items", "html", "caption", "footnote")
NOISE = ("page_header", "page_footer", "page_number")
CHUNKS = "doc_id long, chunk_index int, chunk_type string, page_idx int, section_path array<string>, chunk_text string, tokens long"
_CJK = re.compile("[一-鿿　-ヿ＀-￯]")


def blocks_of_lines(documents: DataFrame) -> DataFrame:
    """Every line of a text (doc_id, text) as a paragraph block."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "text"))
    return _filled(rows.select("doc_id", "block_idx", F.lit("paragraph").alias("type"), "text"))


def blocks_of_html(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs, list items and tables of pages (doc_id, html), in their order; an item is a list block."""
    tag = r"(?is)<(h[1-6]|p|li)\b[^>]*>.*?</\1>|<table\b[^>]*>.*?</table>"
    rows = pages.select("doc_id", F.posexplode(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).alias("block_idx", "raw"))
    kind = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]+>", " "), r"\s+", " "))
    rows = rows.select("doc_id", "block_idx", "raw", kind.alias("kind"), text.alias("text"))
    item = F.array(F.struct(F.lit(0).alias("ilevel"), F.lit("-").alias("prefix"), F.col("text")))
    return _filled(
        rows.select(
            "doc_id", "block_idx",
            F.when(F.col("kind").rlike("^h[1-6]$"), "title").when(F.col("kind") == "li", "list").when(F.col("kind") == "table", "table").otherwise("paragraph").alias("type"),
            F.when(F.col("kind").rlike("^h[1-6]$"), F.substring("kind", 2, 1).cast("int")).alias("level"),
            "text", F.when(F.col("kind") == "li", item).alias("items"), F.when(F.col("kind") == "table", F.col("raw")).alias("html"),
        )
    )


def _filled(rows: DataFrame) -> DataFrame:
    types = {"page_idx": "int", "block_idx": "int", "type": "string", "level": "int", "text": "string", "items": "array<struct<ilevel:int,prefix:string,text:string>>", "html": "string", "caption": "string", "footnote": "string"}
    here = set(rows.columns)
    return rows.select("doc_id", *[(F.col(c) if c in here else F.lit(0 if c == "page_idx" else None)).cast(t).alias(c) for c, t in types.items()])


def peek(blocks: DataFrame) -> DataFrame:
    """(doc_id, pages, blocks, tables, titles, first_titles): counts of a document and its first ten first-level titles that aren't blank."""
    title = F.when((F.col("type") == "title") & (F.coalesce("level", F.lit(1)) == 1) & (F.trim("text") != ""), F.struct("page_idx", "block_idx", F.trim("text").alias("text")))
    g = blocks.groupBy("doc_id").agg(
        F.countDistinct("page_idx").alias("pages"), F.count("*").alias("blocks"), F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type") == "title").alias("titles"), F.array_sort(F.collect_list(title)).alias("t")
    )
    return g.select("doc_id", "pages", "blocks", "tables", "titles", F.slice(F.col("t.text"), 1, 10).alias("first_titles"))


def token_count(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return math.ceil(cjk / 1.5 + (len(text) - cjk) / 4)


def packed(parts: list[str], limit: int, joiner: str, finer: Callable[[str], list[str]] | None = None) -> list[str]:
    """Consecutive parts joined while their tokens stay within the limit; a part beyond it is split by `finer`, or stands alone."""
    out: list[str] = []
    run: list[str] = []
    size = 0
    for part in parts:
        n = token_count(part)
        if run and (size + n > limit):
            out.append(joiner.join(run))
            run, size = [], 0
        if finer and n > limit:
            out += finer(part)
            continue
        run.append(part)
        size += n
    return out + ([joiner.join(run)] if run else [])


def split_oversized(body: str, limit: int) -> list[str]:
    """Pieces of a text within the limit: whole paragraphs, else whole sentences, else runs of characters."""
    letters = lambda s: limit if _CJK.search(s) else 3 * limit
    runs = lambda s: [s[i : i + letters(s)] for i in range(0, len(s), letters(s))]
    sentences = lambda p: packed([s for s in re.split(r"(?<=[.!?。！？])\s*", p) if s], limit, "", runs)
    return packed(re.split(r"\n\n+", body), limit, "\n\n", sentences)


def item_lines(items: list[dict]) -> list[str]:
    return [" " * max(0, 2 * (x["ilevel"] or 0)) + (x["prefix"] or "-") + " " + (x["text"] or "").strip() for x in items]


def overlapping(lines: list[str], limit: int, overlap: int) -> list[str]:
    """Runs of lines within the limit; each run begins with the last `overlap` lines of the one before."""
    runs: list[list[str]] = [[]]
    for line in lines:
        if runs[-1] and sum(map(token_count, [*runs[-1], line])) > limit:
            runs.append(runs[-1][-overlap:] if overlap else [])
        runs[-1].append(line)
    return ["\n".join(r) for r in runs if r]


def _units(blocks: list[dict], limits: dict) -> Iterator[tuple[int, str, str, tuple, int]]:
    """(run, kind, text, section path, page) of what a document's blocks say. Only units of one run may share a chunk."""
    run, path = 0, ()
    for b in blocks:
        text = (b["text"] or "").strip()
        if b["type"] in NOISE:
            continue
        if b["type"] == "title":
            level = 1 if b["level"] is None else b["level"]
            if text:
                run, path = run + 1, (*[p for p in path if p[0] < level], (level, text))
        elif b["type"] == "table":
            html, caption, note = ((b[k] or "").strip() for k in ("html", "caption", "footnote"))
            if html or caption:
                whole = [f"Table: {caption}"] * bool(caption) + [html] * bool(html) + [f"(footnote: {note})"] * bool(note)
                yield run + 1, "table", "\n\n".join(whole), path, b["page_idx"]
                run += 2
            else:
                run += 1
        elif b["type"] == "list":
            lines = item_lines(list(b["items"] if b["items"] is not None else []))
            text = "\n".join(x for x in lines if re.sub(r"^[\s\-*•]+", "", x)).strip()
            if text and token_count(text) > limits["list_atomic"]:
                for piece in overlapping(lines, limits["target"], limits["overlap"]):
                    run += 1
                    yield run, "list", piece, path, b["page_idx"]
                run += 1
            elif text:
                yield run, "list", text, path, b["page_idx"]
        elif text:
            yield run, "text" if b["type"] == "paragraph" else "other", text, path, b["page_idx"]


def document_chunks(blocks: list[dict], limits: dict) -> Iterator[tuple[str, int, list[str], str]]:
    """(type, page, section path, text) of one document's chunks."""
    for _, group in groupby(_units(blocks, limits), lambda u: u[0]):
        units = list(group)
        path = [title for _, title in units[0][3]]
        head = " > ".join(path) + "\n\n" if path else ""
        at = 0
        for size in _pack_sizes([token_count(u[2]) for u in units], limits["target"]):
            own = units[at : at + size]
            at += size
            kind = own[0][1] if own[0][1] == "table" else "list" if own[0][1] == "list" and all(u[1] != "text" for u in own) else "text"
            body = "\n\n".join(u[2] for u in own)
            cap = limits["hard_cjk"] if _CJK.search(head + body) else limits["hard_ascii"]
            fits = token_count(head + body) <= cap
            for piece in [body] if fits else split_oversized(body, max(1, cap - token_count(head))):
                if len((head + piece).split("\n\n", 1)[-1]) >= limits["min_chars"]:
                    yield kind, own[0][4], path, head + piece


def _pack_sizes(tokens: list[int], target: int) -> Iterator[int]:
    size, total = 0, 0
    for n in tokens:
        if size and total + n > target:
            yield size
            size, total = 0, 0
        size, total = size + 1, total + n
    if size:
        yield size


def chunk_documents(blocks: DataFrame, target: int = 600, list_atomic: int = 1200, hard_cjk: int = 2500, hard_ascii: int = 3000, min_chars: int = 30, overlap: int = 1) -> DataFrame:
    """Chunks of documents given as blocks.

    Titles keep a stack of sections, end a chunk and head those below them; tables stand alone with caption and
    footnote; paragraphs and lists roll up to `target` tokens; a list beyond `list_atomic` tokens is split between
    items with an overlap; a chunk beyond the hard limits is split at paragraphs, sentences, characters. Chunks with
    bodies under `min_chars` characters are dropped.
    """
    limits = {"target": target, "list_atomic": list_atomic, "hard_cjk": hard_cjk, "hard_ascii": hard_ascii, "min_chars": min_chars, "overlap": overlap}
    whole = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*BLOCK_FIELDS))).alias("blocks"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(doc, i, *c) for doc, blocks in zip(f["doc_id"], f["blocks"], strict=True) for i, c in enumerate(document_chunks(list(blocks), limits))]
            out = pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk_type", "page_idx", "section_path", "chunk_text"])
            out["tokens"] = [token_count(t) for t in out["chunk_text"]]
            yield out

    return whole.mapInPandas(run, CHUNKS)
