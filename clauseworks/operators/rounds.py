"""Context windows and the corrective second round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.functions.text import context_header, gap_header, is_blank
from clauseworks.operators.materialize import written


def context_window(hits: DataFrame, chunks: int = 12, longest: int | None = 600, by: str = "query_id", gaps: bool = False) -> DataFrame:
    """(by, context, n_chunks): the first hits in order, each under its header and cut to `longest` characters; one bounded list per query.

    With `gaps` the headers are those of gap analysis, else those of answers.
    """
    w = Window.partitionBy(by).orderBy("pos")
    rows = hits.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= chunks)
    text = F.coalesce("text", F.lit(""))
    pages = F.col("page_numbers") if "page_numbers" in hits.columns else F.lit(None)
    head = gap_header(F.col("_i"), F.col("doc_name"), F.col("section"), F.col("subsection_id")) if gaps else context_header(F.col("_i"), F.col("doc_name"), F.col("chapter"), F.col("section"), F.col("subsection_id"), pages)
    part = F.concat(head, F.lit("\n"), F.substring(text, 1, longest) if longest else text)
    parts = F.array_sort(F.collect_list(F.struct("_i", part.alias("part"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n---\n\n").alias("context"), F.count("*").alias("n_chunks"))


def merge_round(first: DataFrame, second: DataFrame, by: str = "query_id", text: str = "text", number: int = 2) -> DataFrame:
    """The earlier rounds (1 where none is told) and the second one's unseen texts, the first occurrence of each, after it; a text seen before is ignored even with a better score."""
    fresh = second.where(~is_blank(F.col(text))).join(first.select(by, text), [by, text], "left_anti")
    w = Window.partitionBy(by, text).orderBy("pos")
    fresh = fresh.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    last = first.groupBy(by).agg(F.max("pos").alias("_last"))
    order = Window.partitionBy(by).orderBy("pos")
    fresh = fresh.join(last, by, "left").withColumn("pos", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(order)).cast(first.schema["pos"].dataType)).drop("_last")
    told = first if "round" in first.columns else first.withColumn("round", F.lit(1))
    return told.unionByName(fresh.withColumn("round", F.lit(number)), allowMissingColumns=True)


def settle_gaps(analysed: DataFrame) -> DataFrame:
    """A failed analysis is sufficient, and so is an insufficient one without follow-up queries."""
    asked = F.size(F.coalesce("followup_queries", F.array().cast("array<string>")))
    return analysed.withColumn("sufficient", F.coalesce("sufficient", F.lit(True)) | (asked == 0))


def corrective_rounds(first: DataFrame, raw: DataFrame, analyse: Callable[[DataFrame], DataFrame], strategy: Callable[[DataFrame], DataFrame], retrieve: Callable[[DataFrame], DataFrame], max_rounds: int = 1) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(merged hits, all raw hits, last analysis) after rounds until all queries are sufficient or `max_rounds` are over; each round is one job over all queries still open.

    `analyse` makes (query_id, sufficient, followup_queries, ...) from the contexts. Each follow-up is reformulated by the
    strategy like a question of its own, `retrieve` makes hits from (query_id, variant_no, variant_query). The raw lists of
    all rounds go on to rank fusion: their variant numbers follow on those of the rounds before. Queries without hits take no part.
    """
    merged, gaps = first, None
    for number in range(2, max_rounds + 2):
        gaps = written(settle_gaps(analyse(context_window(merged, gaps=True))))
        open_ = gaps.where(~F.col("sufficient"))
        if open_.isEmpty():
            break
        asked = open_.select("query_id", F.posexplode("followup_queries").alias("_f", "query"))
        named = asked.select(F.to_json(F.struct(F.col("query_id").alias("q"), F.col("_f").alias("f"))).alias("_key"), "query_id", "_f", "query")
        made = strategy(named.select(F.col("_key").alias("query_id"), "query")).withColumnRenamed("query_id", "_key").join(named.select("_key", "query_id", "_f"), "_key")
        last = raw.groupBy("query_id").agg(F.max("variant_no").alias("_last"))
        order = Window.partitionBy("query_id").orderBy("_f", "variant_no")
        made = made.join(last, "query_id", "left").withColumn("variant_no", (F.coalesce("_last", F.lit(-1)) + F.row_number().over(order)).cast("int"))
        second = written(retrieve(made.select("query_id", "variant_no", "variant_query")))
        raw = raw.unionByName(second, allowMissingColumns=True)
        merged = written(merge_round(merged, second, number=number))
    return merged, raw, gaps
