"""The built-in plug-ins by name, as functions over DataFrames of all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.functions.text import token_set
from clauseworks.models.registry import CHUNKERS, EMBEDDERS, JUDGES, RERANKERS, RETRIEVERS, STRATEGIES, overlap_scores
from clauseworks.operators import chunking, hierarchy, judge, rerank, retrieval
from clauseworks.schema import Config

CHUNKERS.add("baseline")(chunking.chunk)


@RETRIEVERS.add("bm25")
def keyword(variants: DataFrame, chunks: DataFrame, config: Config = Config()) -> DataFrame:
    """`variants`: query_id, query. `chunks`: id, text, vector, level columns, prev_ids, next_ids."""
    return retrieval.keyword_search(variants, chunks, "id", "text", config.top_k)


@RETRIEVERS.add("vector")
def vector(variants: DataFrame, chunks: DataFrame, config: Config = Config()) -> DataFrame:
    return retrieval.vector_search(variants, chunks, config.top_k)


@RETRIEVERS.add("hybrid")
def fused(variants: DataFrame, chunks: DataFrame, config: Config = Config()) -> DataFrame:
    return retrieval.hybrid(vector(variants, chunks, config), keyword(variants, chunks, config), config.top_k, config.rrf_k)


@RETRIEVERS.add("hierarchical")
def hierarchical(variants: DataFrame, chunks: DataFrame, config: Config = Config()) -> DataFrame:
    levels = ["id", "doc_name", "chapter", "section"]
    pool = retrieval.vector_search(variants, chunks, config.pool).withColumnRenamed("rank", "pos")
    pool = pool.join(chunks.select(*levels, "text", "prev_ids", "next_ids"), "id")
    return hierarchy.hierarchical_search(pool, chunks.select(*levels, "vector", "text", "prev_ids", "next_ids"), chunks.select("id", "text"), variants.select("query_id", "vector"), config)


# Rerankers take the merged hits, the queries (query_id, query), the raw hits of all variants and rounds, and the parameters.
@RERANKERS.add("none")
def by_score(hits: DataFrame, queries: DataFrame, raw: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    return rerank.rerank_none(hits, config.rerank_top_k)


@RERANKERS.add("rrf")
def by_fusion(hits: DataFrame, queries: DataFrame, raw: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Fusion of all raw lists; of the merged list alone where there are none. Fused ids that the merged hits lack, as their text is another's, are left out."""
    if raw is None:
        return rerank.rerank_fused(hits, config.rerank_top_k, config.rrf_k)
    lists = raw.select("query_id", "id", F.col("variant_no").alias("list_no"), (F.col("rank") - 1).alias("rank0"))
    fused = retrieval.fuse(lists, rrf_k=config.rrf_k).select("query_id", "id", F.col("score").alias("relevance_score"), F.col("rank").alias("_place"))
    out = hits.drop("rank", "relevance_score").join(fused, ["query_id", "id"])
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_place"))).where(F.col("rank") <= config.rerank_top_k)
    return out.withColumn("index", F.col("rank") - 1).drop("_place")


by_score.reads_text = by_fusion.reads_text = False  # a sweep's hits then go without their texts


@RERANKERS.add("llm")
def by_model(hits: DataFrame, queries: DataFrame, raw: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    return rerank.rerank_scored(hits, overlap_scores(hits, queries), top_k=config.rerank_top_k)


@JUDGES.add("pairwise")
def pairwise(rows: DataFrame) -> DataFrame:
    """Pairs (pair_id, query, answer_a, answer_b) judged in both orders and merged: the answer with more of the question's words, a tie where as many."""
    told = lambda x, y, names: F.when(x == y, F.lit("tie")).when(x > y, F.lit(names[0])).otherwise(F.lit(names[1]))
    share = lambda c: F.size(F.array_intersect(token_set(F.col("query")), token_set(F.col(c))))
    a, b = share("answer_a"), share("answer_b")
    sure = F.least(F.lit(5), F.abs(a - b) + 1)
    straight = rows.select("pair_id", F.lit(False).alias("swapped"), told(a, b, "AB").alias("winner"), sure.alias("confidence"))
    swapped = rows.select("pair_id", F.lit(True).alias("swapped"), told(b, a, "AB").alias("winner"), sure.alias("confidence"))
    return judge.merge_swapped(straight.unionByName(swapped))


def check_names(embedder: str, retriever: str, reranker: str, strategy: str, judges: tuple[str, ...] = ()) -> None:
    """KeyError for a name that no family has."""
    for family, name in ((EMBEDDERS, embedder), (RETRIEVERS, retriever), (RERANKERS, reranker), (STRATEGIES, strategy), *((JUDGES, j) for j in judges)):
        family.get(name)


def with_positions(hits: DataFrame) -> DataFrame:
    """Hits with `pos` from their rank, as reranking and deduplication order by it."""
    return hits.withColumn("pos", F.col("rank"))
