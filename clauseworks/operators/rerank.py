"""Deduplication, rerankers and post-processing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.functions.text import is_blank, score_lines, token_set
from clauseworks.operators.retrieval import fuse
from clauseworks.schema import Config

PLACES = 6


def dedupe(hits: DataFrame, text: str = "text", prefer: tuple[str, ...] = ("score", "relevance_score"), by: str = "query_id") -> DataFrame:
    """The best-scoring row of each text, at the position where the text was first seen; rows without text are dropped.

    Of equal scores the first row stays. The order of the result is `pos`, not score. Hits are brought together by query,
    whose lists are bounded, as reranking, levels and diversity need them too: one exchange serves them all.
    """
    best = F.coalesce(*[F.col(c) for c in prefer if c in hits.columns], F.lit(0.0))
    w = Window.partitionBy(by, text)
    rows = hits.where(~is_blank(F.col(text))).withColumn("_best", best).repartition(by)
    rows = rows.withColumn("_first", F.min("pos").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col("_best").desc(), "pos")))
    return rows.where(F.col("_rn") == 1).withColumn("pos", F.col("_first")).drop("_best", "_first", "_rn")


def best_of_texts(hits: DataFrame, key: list[str], score: Column, pos: str, payload: list[str]) -> DataFrame:
    """Like dedupe, but as one aggregate with partial sums: for hot keys, and where the payload is small."""
    row = F.struct(*payload)
    return hits.groupBy(*key).agg(F.max_by(row, F.struct(score, -F.col(pos))).alias("_r"), F.min(pos).alias("first_pos")).select(*key, "_r.*", "first_pos")


def rerank_none(hits: DataFrame, top_k: int = 20, by: str = "query_id") -> DataFrame:
    """By score; relevance_score is the score, index is 0 for all."""
    w = Window.partitionBy(by).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "pos")
    out = hits.withColumns({"relevance_score": F.coalesce("score", F.lit(0.0)), "index": F.lit(0), "rank": F.row_number().over(w)})
    return out.where(F.col("rank") <= top_k)


def rerank_fused(hits: DataFrame, top_k: int = 20, rrf_k: int = 60, by: str = "query_id") -> DataFrame:
    """Rank fusion of one list: the order stays, relevance_score is 1 / (rrf_k + place)."""
    w = Window.partitionBy(by).orderBy("pos")
    out = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return out.withColumns({"relevance_score": F.round(1.0 / (F.lit(rrf_k) + F.col("rank")), PLACES + 2), "index": F.col("rank") - 1})


def rerank_lists(lists: DataFrame, top_k: int = 20, rrf_k: int = 60) -> DataFrame:
    """Rank fusion over all variants' raw lists (query_id, id, list_no, rank0), later rounds' lists included, by id and not by text; an id's first place in any list breaks ties."""
    return fuse(lists, rrf_k=rrf_k, k=top_k).withColumnRenamed("score", "relevance_score")


def rerank_scored(hits: DataFrame, scores: DataFrame, head: int = 30, top_k: int = 20, default: float = 5.0, by: str = "query_id") -> DataFrame:
    """A model's scores 0..10 (query_id, id, model_score) for the first `head` hits in their given order; sorted, cut, divided by 10. A missing score is the default."""
    w = Window.partitionBy(by).orderBy("pos")
    first = hits.withColumn("index", F.row_number().over(w) - 1).where(F.col("index") < head)
    out = first.join(scores.select(by, "id", "model_score"), [by, "id"], "left").withColumn("_s", F.coalesce("model_score", F.lit(default)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("_s").desc(), "index"))).where(F.col("rank") <= top_k)
    return out.withColumn("relevance_score", F.col("_s") / 10).drop("_s", "model_score")


def listwise_batches(hits: DataFrame, head: int = 30, size: int = 5, longest: int = 1500, by: str = "query_id") -> DataFrame:
    """(by, batch, ids, passages): the first `head` hits of each query in batches of `size`, numbered from 1 and cut to `longest` characters, as a model is shown them in one call."""
    first = hits.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy("pos")) - 1).where(F.col("_i") < head)
    first = first.select(by, F.floor(F.col("_i") / size).cast("int").alias("batch"), (F.col("_i") % size + 1).alias("n"), "id", F.substring(F.coalesce("text", F.lit("")), 1, longest).alias("t"))
    rows = first.groupBy(by, "batch").agg(F.array_sort(F.collect_list(F.struct("n", "id", "t"))).alias("_b"))  # `size` each
    said = F.array_join(F.transform("_b", lambda x: F.concat(F.format_string("[%d] ", x["n"]), x["t"])), "\n\n")
    return rows.select(by, "batch", F.transform("_b", lambda x: x["id"]).alias("ids"), said.alias("passages"))


def listwise_scores(replies: DataFrame, size: int = 5, default: float = 5.0, by: str = "query_id") -> DataFrame:
    """(by, id, model_score) of batches with a model's `reply` of a line per passage; a failed call, a null reply, gives the default to all of its batch."""
    scored = replies.select(by, F.arrays_zip("ids", F.slice(score_lines(F.col("reply"), size, default), F.lit(1), F.size("ids")).alias("scores")).alias("_z"))
    return scored.select(by, F.explode("_z").alias("_z")).select(by, F.col("_z.ids").alias("id"), F.col("_z.scores").alias("model_score"))


def relevance_filter(hits: DataFrame, threshold: float = 0.01) -> DataFrame:
    """relevance_score of at least the threshold, a missing one being 0; a threshold of 0 or less keeps all."""
    return hits if threshold <= 0 else hits.where(F.coalesce("relevance_score", F.lit(0.0)) >= threshold)


def diversify(hits: DataFrame, lam: float = 0.7, top_k: int = 20, text: str = "text", by: str = "query_id") -> DataFrame:
    """Maximal marginal relevance: (by, id, pick from 0), greedily lam * relevance - (1 - lam) * highest Jaccard to those picked.

    The first pick is the most relevant; ties go to the earlier position. Each query's candidates, a reranked and so bounded
    list, are gathered by one partial aggregate and picked from in Arrow batches; no pairs of rows are made.
    """
    rel = F.coalesce(*[F.col(c) for c in ("relevance_score", "score") if c in hits.columns], F.lit(0.0)).cast("double")
    lists = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "id", rel.alias("rel"), token_set(F.col(text)).alias("toks")))).alias("_c"))
    lists = lists.select(by, F.transform("_c", lambda x: x["id"]).alias("_ids"), F.transform("_c", lambda x: x["rel"]).alias("_rel"), F.transform("_c", lambda x: x["toks"]).alias("_toks"))

    @F.pandas_udf("array<int>")
    def picks(rels: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([greedy(list(r), [frozenset(t) for t in ts], lam, top_k) for r, ts in zip(rels, tokens)])

    picked = lists.select(by, "_ids", F.posexplode(picks("_rel", "_toks")).alias("pick", "_at"))
    return picked.select(by, F.get("_ids", F.col("_at")).alias("id"), "pick")


def greedy(rel: list[float], tokens: list[frozenset], lam: float, top_k: int) -> list[int]:
    """Indexes in order of picking; values are compared to 9 places, the first of equal ones wins."""
    left, out, near = list(range(len(rel))), [], [0.0] * len(rel)
    while left and len(out) < top_k:
        worth = [round(rel[i] if not out else lam * rel[i] - (1 - lam) * near[i], 9) for i in left]
        best = left.pop(worth.index(max(worth)))
        out.append(best)
        for i in left:
            union = len(tokens[i] | tokens[best]) if tokens[i] and tokens[best] else 0
            near[i] = max(near[i], len(tokens[i] & tokens[best]) / union if union else 0.0)
    return out


STEPS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {
    "dedupe": lambda h, c: dedupe(h, prefer=("relevance_score", "score")),
    "relevance_filter": lambda h, c: relevance_filter(h, c.relevance_threshold),
    "mmr": lambda h, c: h.join(diversify(h, c.mmr_lambda, c.rerank_top_k), ["query_id", "id"]).withColumn("pos", F.col("pick")).drop("pick"),
}


def post_process(hits: DataFrame, config: Config = Config(), warn: Callable[[str], None] = lambda m: None) -> DataFrame:
    """The named steps in order; unknown names are warned of and skipped."""

    def run(h: DataFrame, name: str) -> DataFrame:
        if name not in STEPS:
            warn(f"unknown post-processing step {name!r} skipped")
            return h
        return STEPS[name](h, config)

    return reduce(run, config.post_processing, hits)
