"""The whole query path over DataFrames: variants, retrieval, rounds, reranking, post-processing, answers, traces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.operators import rerank, rounds
from clauseworks.operators.materialize import written
from clauseworks.schema import Config

NO_ANSWER = "No relevant provisions were found for this question."


@dataclass
class Pipeline:
    """Named parts that all take and give DataFrames of all queries at once.

    `strategy`: (query_id, query) to (query_id, variant_no, variant_query). `retrieve`: variants to hits (query_id, id, text,
    score, pos, variant_no, rank, ...). `rerank`: (hits, queries, raw lists of all rounds) to hits with relevance_score and pos. `analyse`: contexts to gap
    analyses. `generate`: contexts to (query_id, answer).
    """

    strategy: Callable[[DataFrame], DataFrame]
    retrieve: Callable[[DataFrame], DataFrame]
    rerank: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
    analyse: Callable[[DataFrame], DataFrame] | None = None
    generate: Callable[[DataFrame], DataFrame] | None = None
    config: Config = Config()

    def run(self, queries: DataFrame, first: DataFrame | None = None) -> dict[str, DataFrame]:
        """All stages' frames. `first`: hits of the first retrieval, from another run with the same strategy and retriever."""
        asked = self.strategy(queries)
        raw = first = written(self.retrieve(asked)) if first is None else first
        merged, gaps = rerank.dedupe(raw), None
        if self.config.two_call and self.analyse:
            merged, raw, gaps = rounds.corrective_rounds(merged, raw, self.analyse, self.strategy, self.retrieve, self.config.max_rounds)
        final = written(rerank.post_process(self.rerank(merged, queries, raw), self.config))
        out = {"variants": asked, "first": first, "raw": raw, "merged": merged, "final": final}
        if gaps is not None:
            out["gaps"] = gaps
        if self.generate:
            contexts = rounds.context_window(final, self.config.rerank_top_k, None)
            answers = queries.select("query_id").join(self.generate(contexts), "query_id", "left")
            out["answers"] = answers.withColumn("answer", F.coalesce("answer", F.lit(NO_ANSWER)))
        return out


def traces(hits: DataFrame) -> DataFrame:
    """(query_id, variants): each query's variants with their results in order, nested; a query's hits are bounded by variants x top k."""
    result = F.struct("result_rank", "id", "score")
    per = hits.groupBy("query_id", "variant_no").agg(F.array_sort(F.collect_list(result)).alias("results"))
    return per.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("variant_no", "results"))).alias("variants"))


def overview(traced: DataFrame) -> DataFrame:
    """(query_id, results, variants, distinct_results, best) of nested traces."""
    flat = F.flatten(F.transform("variants", lambda v: v["results"]))
    rows = traced.select("query_id", F.size("variants").cast("long").alias("variants"), flat.alias("_r"))
    best = F.aggregate("_r", F.lit(0.0), lambda m, r: F.greatest(m, F.coalesce(r["score"], F.lit(0.0))))
    lowest = F.array_max(F.transform("_r", lambda r: F.coalesce(r["score"], F.lit(0.0))))
    return rows.select("query_id", F.size("_r").cast("long").alias("results"), "variants", F.size(F.array_distinct(F.transform("_r", lambda r: r["id"]))).cast("long").alias("distinct_results"), F.round(F.coalesce(lowest, best), 6).alias("best"))


def counts(out: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, raw, variants, merged, round2_added, neighbor_expanded, sufficient, followups, final) of a pipeline's run: what each stage had of each query."""
    n = F.count("*")
    merged, final = out["merged"], out["final"]
    late = F.count_if(F.col("round") > 1) if "round" in merged.columns else F.lit(0).cast("long")
    grown = F.count_if(F.col("neighbor_added").isNotNull()) if "neighbor_added" in final.columns else F.lit(0).cast("long")
    parts = [
        out["raw"].groupBy("query_id").agg(n.alias("raw"), F.count_distinct("variant_no").alias("variants")),
        merged.groupBy("query_id").agg(n.alias("merged"), late.alias("round2_added")),
        final.groupBy("query_id").agg(n.alias("final"), grown.alias("neighbor_expanded")),
    ]
    if "gaps" in out:
        parts.append(out["gaps"].select("query_id", "sufficient", F.size("followup_queries").cast("long").alias("followups")))
    rows = queries.select("query_id").distinct()
    for p in parts:
        rows = rows.join(p, "query_id", "left")
    number = [c for c, t in rows.dtypes if t == "bigint" and c != "query_id"]
    return rows.select("query_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in number else F.col(c) for c in rows.columns if c != "query_id"])
