"""Folding page items into ordered subsections, with windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.functions.text import is_blank, strip

PREAMBLE, GENERAL, UNNAMED, ORPHAN = "Preamble", "General", "N/A", "Introduction/Continuation"


def page_union(pages: Column) -> Column:
    """The distinct pages of a group's lists in order: a set of numbers, bounded by a document's pages."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(pages))))


def _joined(text: str, *order: str) -> Column:
    """Texts in order, joined with blanks."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), " ")


def fold_items(items: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, seq, chapter, section, subsection_id, subsection_text, page_numbers) from page items (doc, page, item, type, content, id).

    Chapter and section run on until the next header; a chapter header sets the section back. Headers and new subsections
    open a group, continuations extend it; a group carries what was in force when it opened. Groups without text vanish,
    then neighbours with the same id are merged. A continuation at a document's start is named so, a missing id is "N/A".
    A document is ordered in one task; documents spread over tasks.
    """
    order = Window.partitionBy(doc).orderBy("page", "item")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind, content = F.col("type"), F.coalesce("content", F.lit(""))
    chapter = F.last(F.when(kind == "chapter_header", content), ignorenulls=True).over(so_far)
    section = F.last(F.when(kind == "chapter_header", F.lit(GENERAL)).when(kind == "section_header", content), ignorenulls=True).over(so_far)
    rows = items.select(
        doc, "page", "item", content.alias("_text"), (kind.isin("chapter_header", "section_header")).alias("_head"),
        F.coalesce(chapter, F.lit(PREAMBLE)).alias("chapter"), F.coalesce(section, F.lit(GENERAL)).alias("section"),
        F.sum(F.when(kind == "continuation", 0).otherwise(1)).over(so_far).alias("_group"),
        F.when(kind == "new_subsection", F.coalesce(F.nullif("id", F.lit("")), F.lit(UNNAMED))).alias("_id"),
        (kind == "continuation").alias("_cont"),
    )
    at = F.struct("page", "item")
    groups = rows.groupBy(doc, "_group").agg(
        F.min(at).alias("_at"),
        F.min_by("chapter", at).alias("chapter"),
        F.min_by("section", at).alias("section"),
        F.min_by(F.when(F.col("_cont"), F.lit(ORPHAN)).otherwise(F.coalesce("_id", F.lit(UNNAMED))), at).alias("subsection_id"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "item", "_head", "_text"))), lambda x: F.when(x["_head"], F.lit("")).otherwise(x["_text"])), " ")).alias("subsection_text"),
        F.array_sort(F.collect_set("page")).alias("page_numbers"),
    )
    return merge_adjacent(groups.where(~is_blank(F.col("subsection_text"))), doc, "_at")


def merge_adjacent(rows: DataFrame, doc: str, order: str) -> DataFrame:
    """Consecutive rows with the same subsection id as one: first chapter and section, texts joined, pages united. "N/A" and empty ids stay apart."""
    w = Window.partitionBy(doc).orderBy(order)
    named = ~F.coalesce("subsection_id", F.lit("")).isin("", UNNAMED)
    new = F.when(named & (F.lag("subsection_id").over(w) == F.col("subsection_id")), 0).otherwise(1)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_new", new).withColumn("_island", island).withColumn("_o", F.col(order))
    out = rows.groupBy(doc, "_island").agg(
        F.min("_o").alias("_first"),
        F.min_by("chapter", "_o").alias("chapter"), F.min_by("section", "_o").alias("section"), F.first("subsection_id").alias("subsection_id"),
        strip(_joined("subsection_text", "_o")).alias("subsection_text"), page_union(F.col("page_numbers")).alias("page_numbers"),
    )
    return out.select(doc, (F.row_number().over(Window.partitionBy(doc).orderBy("_first")) - 1).alias("seq"), "chapter", "section", "subsection_id", "subsection_text", "page_numbers")


def merge_empty_headers(rows: DataFrame, doc: str, order: str) -> DataFrame:
    """Runs of rows without text as one: differing chapters and all sections joined, the last id kept. Rows with text stay."""
    w = Window.partitionBy(doc).orderBy(order)
    empty = is_blank(F.col("subsection_text"))
    new = F.when(empty & F.lag(empty, 1, False).over(w), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_o", F.col(order))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_o", c))), lambda x: x[c])
    out = rows.groupBy(doc, "_run").agg(
        F.min("_o").alias("_first"),
        F.array_join(F.array_distinct(ordered("chapter")), " ").alias("chapter"), F.array_join(ordered("section"), " ").alias("section"),
        F.max_by("subsection_id", "_o").alias("subsection_id"), F.min_by("subsection_text", "_o").alias("subsection_text"), page_union(F.col("page_numbers")).alias("page_numbers"),
    )
    return out.select(doc, (F.row_number().over(Window.partitionBy(doc).orderBy("_first")) - 1).alias("seq"), "chapter", "section", "subsection_id", "subsection_text", "page_numbers")


def opening_text(pages: DataFrame, doc: str = "doc", first: int = 3, longest: int = 5000) -> DataFrame:
    """(doc, text): the first pages' text, from which a document's name and summary are told."""
    rows = pages.where(F.col("page") <= first)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(doc).agg(F.substring(text, 1, longest).alias("text"))
