"""Chunks of subsections: embed texts, splitting, reading-order neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.functions.hashing import chunk_id
from clauseworks.functions.text import embed_piece, embed_text, is_blank, page_list

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters: cut at the first separator that occurs, parts too long at the next ones;
    parts are packed greedily, each piece starting with the last parts of the one before that fit into the overlap.
    A separator stays at the start of the part after it; pieces are stripped."""
    rest: tuple[str, ...] = ()
    sep = separators[-1]
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1 :]
            break
    if sep:
        raw = text.split(sep)
        parts = [p for p in [raw[0], *(sep + p for p in raw[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    fit: list[str] = []

    def pack() -> None:
        window: list[str] = []
        total = 0
        for p in fit:
            if window and total + len(p) > size:
                if piece := "".join(window).strip():
                    out.append(piece)
                while window and (total > overlap or total + len(p) > size):
                    total -= len(window.pop(0))
            window.append(p)
            total += len(p)
        if piece := "".join(window).strip():
            out.append(piece)
        fit.clear()

    for p in parts:
        if len(p) < size:
            fit.append(p)
            continue
        pack()
        if rest:
            out.extend(split_recursively(p, size, overlap, rest))
        else:
            out.append(p)
    pack()
    return out


def pieces(text: Column, size: int = 2048, overlap: int = 204) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_recursively(t, size, overlap) if t else [])

    return run(text)


def chunk(subsections: DataFrame, order: str = "seq", size: int = 2048, overlap: int = 204, context: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Chunks of non-blank subsections: one for a text within `size`, else one per piece with the whole text beside it.

    Only oversized texts go through Python. `context` makes the summary that a piece is embedded with, once per
    subsection, from its text and the document's summary; by default the latter.
    """
    s = subsections.where(~is_blank(F.col("subsection_text"))).select(
        F.coalesce("document_name", F.lit("Unknown Document")).alias("doc_name"), F.coalesce("document_summary", F.lit("")).alias("document_summary"), "chapter", "section", "subsection_id",
        page_list(F.col("page_numbers")).alias("page_numbers"), "subsection_text", F.col(order).alias("seq"),
    )
    null = lambda t: F.lit(None).cast(t)
    short = s.where(F.length("subsection_text") <= size).select(
        "*", embed_text(F.col("document_summary"), F.col("chapter"), F.col("section"), F.col("subsection_text")).alias("text"), F.col("subsection_text").alias("bm25_text"), F.lit(False).alias("is_split"),
        null("string").alias("full_subsection_text"), null("int").alias("chunk_index"), null("int").alias("total_chunks"), null("string").alias("context_summary"),
    )
    make = context or (lambda text, summary: summary)
    long = s.where(F.length("subsection_text") > size).withColumn("_p", pieces(F.col("subsection_text"), size, overlap)).withColumn("context_summary", make(F.col("subsection_text"), F.col("document_summary")))
    long = long.select("*", F.size("_p").alias("total_chunks"), F.posexplode("_p").alias("chunk_index", "_piece")).select(
        "doc_name", "document_summary", "chapter", "section", "subsection_id", "page_numbers", F.col("_piece").alias("subsection_text"), "seq",
        embed_piece(F.col("context_summary"), F.col("chapter"), F.col("section"), F.col("_piece")).alias("text"), F.col("_piece").alias("bm25_text"), F.lit(True).alias("is_split"),
        F.col("subsection_text").alias("full_subsection_text"), "chunk_index", "total_chunks", "context_summary",
    )
    every = short.unionByName(long)
    return every.withColumn("id", chunk_id(F.col("doc_name"), F.col("seq"), F.coalesce("chunk_index", F.lit(0)), F.col("text")))


def embedded_text() -> Column:
    """The embed text of a chunk, from its other columns."""
    part = embed_piece(F.col("context_summary"), F.col("chapter"), F.col("section"), F.col("subsection_text"))
    return F.when(F.col("is_split"), part).otherwise(embed_text(F.col("document_summary"), F.col("chapter"), F.col("section"), F.col("subsection_text")))


def assign_neighbors(rows: DataFrame, doc: str, id_col: str, *order: str, window: int = 2) -> DataFrame:
    """Adds seq (from 0 in each document), prev_ids and next_ids (up to `window`, the nearest first); documents don't mix, a missing name is one document."""
    name = F.coalesce(F.col(doc), F.lit(""))
    w = Window.partitionBy(name).orderBy(*order)
    near = lambda f: F.filter(F.array(*[f(id_col, i).over(w) for i in range(1, window + 1)]), lambda x: x.isNotNull())
    return rows.withColumns({"seq": (F.row_number().over(w) - 1).cast("int"), "prev_ids": near(F.lag), "next_ids": near(F.lead)})


def compact(chunks: DataFrame, limit: int = 40 * 1024) -> DataFrame:
    """(id, meta): metadata as compact JSON without the long texts; more than `limit` bytes is an error."""
    texts = {"id", "text", "bm25_text", "subsection_text", "full_subsection_text"}
    meta = F.to_json(F.struct(*[c for c in chunks.columns if c not in texts]))
    return chunks.select("id", F.when(F.octet_length(meta) <= limit, meta).otherwise(F.raise_error(F.concat(F.lit("metadata too large: "), F.col("id")))).alias("meta"))
