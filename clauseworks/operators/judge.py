"""Evaluation: composites, summaries, leaderboard, comparison, pairwise merge, experiment grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RETRIEVAL, GENERATION = ("ctx_precision", "ctx_sufficiency"), ("faithfulness", "correctness", "answer_relevance")
COMPOSITES = ("retrieval_score", "generation_score", "overall_score")
METRICS = (*RETRIEVAL, *GENERATION, *COMPOSITES)


def mean_of_positive(*values: Column) -> Column:
    """Mean of the values above 0, to 2 places; 0 where none is. 0 stands for "not evaluated"."""
    good = F.filter(F.array(*[v.cast("double") for v in values]), lambda x: x > 0)
    return F.when(F.size(good) > 0, F.round(F.aggregate(good, F.lit(0.0), lambda s, x: s + x) / F.size(good), 2)).otherwise(0.0)


def composites(rows: DataFrame) -> DataFrame:
    col = lambda c: F.col(c) if c in rows.columns else F.lit(0)
    out = rows.withColumns({"retrieval_score": mean_of_positive(*map(col, RETRIEVAL)), "generation_score": mean_of_positive(*map(col, GENERATION))})
    return out.withColumn("overall_score", mean_of_positive(F.col("retrieval_score"), F.col("generation_score")))


def summary(rows: DataFrame, keys: tuple[str, ...] = METRICS, *by: str) -> DataFrame:
    """(by, metric, mean, std, min, max, n) over values above 0, population deviation, 3 places; metrics without values are left out."""
    long = rows.unpivot(list(by), [F.col(k).cast("double").alias(k) for k in keys if k in rows.columns], "metric", "value").where((F.col("value") > 0) & ~F.isnan("value"))
    r = lambda c: F.round(c, 3)
    return long.groupBy(*by, "metric").agg(r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("std"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"), F.count("*").alias("n"))


def leaderboard(rows: DataFrame, sort_by: str = "overall_score", keys: tuple[str, ...] = METRICS) -> DataFrame:
    """One row per experiment with its metrics' means, best first; a missing mean stays null and sorts as 0."""
    mean = lambda k: F.round(F.avg(F.when(F.col(k) > 0, F.col(k).cast("double"))), 3).alias(k)
    out = rows.groupBy("experiment").agg(F.count("*").alias("n_queries"), *[mean(k) for k in keys if k in rows.columns])
    w = Window.partitionBy().orderBy(F.coalesce(sort_by, F.lit(0.0)).desc(), "experiment")  # one row per experiment
    return out.withColumn("place", F.row_number().over(w))


def compare(summaries: DataFrame, a: str, b: str, label: str = "experiment") -> DataFrame:
    """(metric, mean_a, mean_b, delta, winner) of two experiments' summaries; a tie within 0.05 or where either mean is missing or 0."""
    side = lambda x, n: summaries.where(F.col(label) == x).select("metric", F.col("mean").alias(n))
    both = side(a, "mean_a").join(side(b, "mean_b"), "metric", "full_outer").fillna(0.0, ["mean_a", "mean_b"])
    delta = F.round(F.col("mean_b") - F.col("mean_a"), 3)
    tie = (F.abs(delta) < 0.05) | (F.col("mean_a") == 0) | (F.col("mean_b") == 0)
    return both.withColumn("delta", delta).withColumn("winner", F.when(tie, "tie").when(delta > 0, b).otherwise(a))


def compare_all(summaries: DataFrame, label: str = "experiment") -> DataFrame:
    """Every two experiments, the earlier label first; experiments are a handful of configurations, joined on the metric."""
    x, y = summaries.alias("x"), summaries.alias("y")
    both = x.join(y, (F.col("x.metric") == F.col("y.metric")) & (F.col(f"x.{label}") < F.col(f"y.{label}")))
    delta = F.round(F.col("y.mean") - F.col("x.mean"), 3)
    out = both.select(F.col(f"x.{label}").alias("label_a"), F.col(f"y.{label}").alias("label_b"), F.col("x.metric").alias("metric"), F.col("x.mean").alias("mean_a"), F.col("y.mean").alias("mean_b"), delta.alias("delta"))
    tie = (F.abs("delta") < 0.05) | (F.col("mean_a") == 0) | (F.col("mean_b") == 0)
    return out.withColumn("winner", F.when(tie, "tie").when(F.col("delta") > 0, F.col("label_b")).otherwise(F.col("label_a")))


def merge_swapped(verdicts: DataFrame) -> DataFrame:
    """(pair_id, winner, confidence, position_bias) from two verdicts a pair, one with the sides swapped.

    `verdicts`: pair_id, swapped, winner (A, B or tie; null for a failure), confidence. The swapped verdict is translated
    back; agreement gives the winner and the mean confidence, disagreement a tie of confidence 1 with position bias, a
    failure JUDGE_ERROR.
    """
    side = F.when(F.col("swapped") & (F.col("winner") == "A"), "B").when(F.col("swapped") & (F.col("winner") == "B"), "A").otherwise(F.col("winner"))
    one = lambda s, c: F.max(F.when(F.col("swapped") == s, c))
    v = verdicts.withColumn("_w", side).groupBy("pair_id").agg(one(False, F.col("_w")).alias("w1"), one(True, F.col("_w")).alias("w2"), one(False, F.col("confidence")).alias("c1"), one(True, F.col("confidence")).alias("c2"))
    failed, agree = F.col("w1").isNull() | F.col("w2").isNull(), F.col("w1") == F.col("w2")
    return v.select(
        "pair_id", F.when(failed, "JUDGE_ERROR").when(agree, F.col("w1")).otherwise("tie").alias("winner"),
        F.when(failed, 0.0).when(agree, F.round((F.col("c1") + F.col("c2")) / 2, 2)).otherwise(1.0).alias("confidence"), (~failed & ~agree).alias("position_bias"),
    )


def grid(spark: SparkSession, embedders: list[str], retrievers: list[str], rerankers: list[str], strategies: list[str], two_call: list[bool]) -> DataFrame:
    """Experiment combinations with their labels: the product of a few literal axes, made from one row by exploding arrays, without a join."""
    one = spark.range(1)
    for name, values in (("embedder", embedders), ("retriever", retrievers), ("reranker", rerankers), ("strategy", strategies), ("two_call", two_call)):
        one = one.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return one.drop("id").withColumn("label", F.concat_ws("__", "embedder", "retriever", "reranker", "strategy", F.when(F.col("two_call"), "tc1").otherwise("tc0")))


def runnable(combos: DataFrame, has_keyword_index: bool) -> DataFrame:
    return combos if has_keyword_index else combos.where(~F.col("retriever").isin("bm25", "hybrid"))


def union_of_results(*frames: DataFrame) -> DataFrame:
    """All rows with the union of the columns in sorted order, blanks for what is missing."""
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    return both.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(both.columns)])


def with_references(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Queries with their reference answers by stripped text; the last of several references counts."""
    from clauseworks.functions.text import strip

    refs = references.select(strip(F.col("question")).alias("_q"), "answer", "pos").groupBy("_q").agg(F.max_by("answer", "pos").alias("reference"))
    return queries.withColumn("_q", strip(F.col("query"))).join(refs, "_q", "left").drop("_q")
