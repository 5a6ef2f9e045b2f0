"""Hierarchy-aware retrieval: group ranks, level filters, siblings, reading-order neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.functions.vectors import cosine, exact_top_k
from clauseworks.operators.materialize import written
from clauseworks.schema import Config

CONTAINMENT = ("doc_name", "chapter", "section")
PLACES, GROUP_PLACES = 6, 9


def group_key(level: str) -> list[str]:
    """The columns that name a group: containment down to the level; a field outside of it alone."""
    return list(CONTAINMENT[: CONTAINMENT.index(level) + 1]) if level in CONTAINMENT else [level]


def group_scores(hits: DataFrame, level: str, score: str = "base_score", count_bonus: float = 0.25, by: str = "query_id") -> DataFrame:
    """(by, group columns, group_score, group_rank from 0): the best hit's score and a part of the mean; ties in order of first appearance."""
    keys = group_key(level)
    s = F.coalesce(F.col(score), F.lit(0.0))
    named = hits.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in keys})
    out = named.groupBy(by, *keys).agg(F.round(F.max(s) + count_bonus * F.avg(s), GROUP_PLACES).alias("group_score"), F.min("pos").alias("_first"))
    w = Window.partitionBy(by).orderBy(F.col("group_score").desc(), "_first")
    return out.withColumn("group_rank", F.row_number().over(w) - 1).drop("_first")


def filter_level(hits: DataFrame, level: str, keep: int, level_bonus: float = 0.10, count_bonus: float = 0.25, by: str = "query_id") -> DataFrame:
    """Hits of the best groups, by base score; score gains level_bonus / (1 + rank), and the rank is kept as hier_<level>_rank.

    Group scores and ranks are window aggregates, all inside a query, so hits that are partitioned by query stay where they
    are and are read once. Groups of equal score rank by first appearance, then by name.
    """
    keys = group_key(level)
    named = hits.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in keys})
    group = Window.partitionBy(by, *keys)
    s = F.coalesce(F.col("base_score"), F.lit(0.0))
    out = named.withColumns({"_gs": F.round(F.max(s).over(group) + count_bonus * F.avg(s).over(group), GROUP_PLACES), "_first": F.min("pos").over(group)})
    out = out.withColumn("_gr", F.dense_rank().over(Window.partitionBy(by).orderBy(F.col("_gs").desc(), "_first", *keys)) - 1).where(F.col("_gr") < keep)
    return out.withColumn("score", F.col("score") + F.lit(level_bonus) / (1 + F.col("_gr"))).withColumnRenamed("_gr", f"hier_{level}_rank").drop("_gs", "_first")


def apply_levels(hits: DataFrame, levels: tuple[tuple[str, int], ...] = Config.levels, level_bonus: float = 0.10, count_bonus: float = 0.25, top_k: int | None = None, by: str = "query_id") -> DataFrame:
    """Level after level, each seeing the survivors only and ranking by base score, bonuses adding up; sorted by boosted score, then position, and cut. One exchange, by query."""
    start = hits.withColumns({"base_score": F.coalesce("score", F.lit(0.0)), "score": F.coalesce("score", F.lit(0.0))}) if "base_score" not in hits.columns else hits
    out = reduce(lambda h, level: filter_level(h, level[0], level[1], level_bonus, count_bonus, by), levels, start.repartition(by))
    w = Window.partitionBy(by).orderBy(F.round("score", PLACES).desc(), "pos", "id")
    out = out.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top_k) if top_k else out


def siblings(hits: DataFrame, candidates: DataFrame, query_vectors: DataFrame, level: str = "section", groups: int = 5, per_group: int = 5, by: str = "query_id", qualified: bool = False) -> DataFrame:
    """Hits and the nearest members of their best groups that aren't hits already, flagged sibling_expanded.

    The groups are the best of the innermost level by raw score; blank values are skipped. Members are found by the level's
    own value, so a section of the same name in another document counts; `qualified` asks for the parents too. Each kept
    group is a query of the exact vector search over its own members (`candidates`: id, vector, level columns), so
    candidates are read once and never joined with the groups. `hits` is written, as several steps read it.
    """
    hits = written(hits)
    best = group_scores(hits, level, "score", by=by).where((F.col("group_rank") < groups) & (F.trim(F.col(level)) != ""))
    keys = group_key(level) if qualified else [level]
    named = lambda df: F.concat_ws("\u0001", *[F.coalesce(F.col(k), F.lit("")) for k in keys])
    asked = best.join(query_vectors.select(F.col(by), F.col("vector")), by).withColumn("_same", named(best))
    asked = written(asked.select(by, "group_rank", *group_key(level), "vector", "_same", F.concat_ws("\u0001", F.col(by).cast("string"), F.col("group_rank").cast("string")).alias("_asked")))
    near = exact_top_k(asked.select(F.col("_asked").alias("query_id"), "vector", "_same"), candidates.withColumn("_same", named(candidates)), per_group, "_same")
    near = near.select(F.col("query_id").alias("_asked"), "id", F.col("rank").alias("_k"), "score")
    found = near.join(asked.select("_asked", by, "group_rank"), "_asked").drop("_asked")
    own = [c for c in candidates.columns if c in hits.columns and c not in ("id", "score", by)]
    fresh = found.join(hits.select(by, "id"), [by, "id"], "left_anti").join(candidates.select("id", *own), "id")
    first = Window.partitionBy(by, "id").orderBy("group_rank", "_k")
    fresh = fresh.withColumn("_f", F.row_number().over(first)).where(F.col("_f") == 1)
    last = hits.groupBy(by).agg(F.max("pos").alias("_last"))
    order = Window.partitionBy(by).orderBy("group_rank", "_k")
    fresh = fresh.join(last, by).withColumn("pos", (F.col("_last") + F.row_number().over(order)).cast(hits.schema["pos"].dataType)).withColumn("sibling_expanded", F.lit(True))
    old = hits.withColumn("sibling_expanded", F.lit(False))
    return old.unionByName(fresh.select([F.col(c) if c in fresh.columns else F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in old.columns]))


def relevance_class(score: Column, high: float = 0.65, low: float = 0.30) -> Column:
    return F.when(score >= high, "high").when(score <= low, "low").otherwise("medium")


def passing(scores: Column, least: float = 0.40) -> Column:
    """How many scores from the start reach `least`, up to the first that doesn't; a null ends the run."""
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda s, x: F.struct((s["n"] + F.when(s["on"] & F.coalesce(x >= least, F.lit(False)), 1).otherwise(0)).alias("n"), (s["on"] & F.coalesce(x >= least, F.lit(False))).alias("on"))
    return F.aggregate(scores, state, step, lambda s: s["n"])


def splice(before: Column, text: Column, after: Column) -> Column:
    """Earlier texts (nearest first, so reversed), the text, later texts, with blank lines between; empty ones left out."""
    return F.array_join(F.filter(F.concat(F.reverse(before), F.array(text), after), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")


def neighbours(hits: DataFrame, vectors: DataFrame, texts: DataFrame, query_vectors: DataFrame, config: Config = Config(), by: str = "query_id") -> DataFrame:
    """Hits with relevance (of base_score) and, for medium ones, the texts of adjoining chunks that are similar enough to the query spliced on.

    `hits` has prev_ids and next_ids, nearest first. Up to max_hops of each side are looked at, up to the first without a
    vector or below `moderate`. Only medium hits are exploded and joined, by id.
    """
    rows = hits.withColumn("relevance", relevance_class(F.col("base_score"), config.high, config.low))
    medium = rows.where(F.col("relevance") == "medium").select(by, "id", "prev_ids", "next_ids")
    side = lambda c, name: medium.select(by, "id", F.lit(name).alias("side"), F.posexplode(F.slice(c, 1, config.max_hops)).alias("hop", "near_id"))
    asked = side("prev_ids", "prev").unionByName(side("next_ids", "next"))
    asked = asked.join(query_vectors.select(by, F.col("vector").alias("_qv")), by)
    asked = asked.join(vectors.select(F.col("id").alias("near_id"), F.col("vector").alias("_v")), "near_id", "left").join(texts.select(F.col("id").alias("near_id"), F.col("text").alias("near_text")), "near_id", "left")
    near = F.when(F.col("_v").isNotNull(), F.round(cosine(F.col("_qv"), F.col("_v")), PLACES))
    gathered = asked.select(by, "id", "side", "hop", near.alias("near"), "near_text").groupBy(by, "id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("hop", "near", "near_text")))).alias(f"_{s}") for s in ("prev", "next")
    ])  # fmt: skip  at most max_hops each
    out = rows.join(gathered, [by, "id"], "left")
    empty = F.array().cast("array<struct<hop:int,near:double,near_text:string>>")
    for s in ("prev", "next"):
        seen = F.coalesce(F.col(f"_{s}"), empty)
        out = out.withColumn(f"_{s}", F.slice(seen, F.lit(1), passing(F.transform(seen, lambda x: x["near"]), config.moderate)))
    added = F.struct(F.transform("_prev", lambda x: x["near"]).alias("prev"), F.transform("_next", lambda x: x["near"]).alias("next"))
    text = splice(F.transform("_prev", lambda x: x["near_text"]), F.col("text"), F.transform("_next", lambda x: x["near_text"]))
    grown = (F.size("_prev") + F.size("_next")) > 0
    return out.withColumns({"neighbor_added": F.when(grown, added), "text": F.when(grown, text).otherwise(F.col("text"))}).drop("_prev", "_next")


def hierarchical_search(pool: DataFrame, candidates: DataFrame, texts: DataFrame, query_vectors: DataFrame, config: Config = Config()) -> DataFrame:
    """Pool, siblings, levels, cut to top_k, neighbours. `pool` has query_id, id, score, pos, the level columns, text, prev_ids and next_ids."""
    wide = siblings(pool, candidates, query_vectors, config.sibling_level, dict(config.levels)[config.sibling_level], config.siblings_per_group)
    kept = apply_levels(wide, config.levels, config.level_bonus, config.count_bonus, config.top_k)
    return neighbours(kept, candidates, texts, query_vectors, config)
