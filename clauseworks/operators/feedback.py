"""Responses, ratings and their analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.functions.text import strip
from clauseworks.operators.index import keep_first, merge_new

CRITERIA = ("retrieval_relevance", "completeness", "correctness")


def append_responses(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored responses and the new ones, each id once: an id that is stored already stays as it is, so a repeated request adds nothing."""
    return merge_new(stored, new.where(F.col("id").isNotNull()))


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """The last rating of each (response, rater), the comment stripped; grades out of 1..5 are null."""
    rows = keep_first(ratings, ["response_id", "rater_id"], [F.col("updated_at").desc_nulls_last(), F.col("id").desc()])
    grade = {c: F.when(F.col(c).between(1, 5), F.col(c)) for c in CRITERIA}
    return rows.withColumns({**grade, "comment_text": F.nullif(strip(F.coalesce("comment_text", F.lit(""))), F.lit(""))})


def totals(responses: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row: responses, ratings, rated responses and the coverage in percent, 0 where there are no responses."""
    n = responses.agg(F.count_distinct("id").alias("responses"))
    r = ratings.agg(F.count("*").alias("ratings"), F.count_distinct("response_id").alias("rated"))
    counts = n.select("responses", F.lit(0).cast("long").alias("ratings"), F.lit(0).cast("long").alias("rated")).unionByName(r.select(F.lit(0).cast("long").alias("responses"), "ratings", "rated"))
    one = counts.agg(*[F.sum(c).alias(c) for c in ("responses", "ratings", "rated")])
    return one.withColumn("coverage", F.when(F.col("responses") > 0, F.round(100.0 * F.col("rated") / F.col("responses"), 1)).otherwise(0.0))


def criterion_stats(ratings: DataFrame) -> DataFrame:
    """(criterion, grade 1..5, n, mean): each criterion's histogram, zero-filled, and its mean to 2 places (0 where there is none).

    All counts are partial sums in one pass over the ratings; the zeros come from the aggregates themselves.
    """
    cells = [F.count_if(F.col(c) == g).alias(f"{c}_{g}") for c in CRITERIA for g in range(1, 6)]
    means = [F.round(F.coalesce(F.avg(F.when(F.col(c).between(1, 5), F.col(c))), F.lit(0.0)), 2).alias(f"{c}_mean") for c in CRITERIA]
    one = ratings.agg(*cells, *means)
    rows = [F.struct(F.lit(c).alias("criterion"), F.lit(g).alias("grade"), F.col(f"{c}_{g}").alias("n"), F.col(f"{c}_mean").alias("mean")) for c in CRITERIA for g in range(1, 6)]
    return one.select(F.inline(F.array(*rows)))


def by_retriever(responses: DataFrame, ratings: DataFrame) -> DataFrame:
    """(retriever, responses, ratings, three means): every response counts once, rated or not; a mean without ratings is 0."""
    per = ratings.groupBy("response_id").agg(F.count("*").alias("_n"), *[f(c).alias(f"_{n}_{c}") for c in CRITERIA for n, f in (("s", F.sum), ("k", F.count))])
    rows = responses.select(F.col("id").alias("response_id"), "retriever").distinct().join(per, "response_id", "left")
    mean = lambda c: F.round(F.coalesce(F.sum(f"_s_{c}") / F.nullif(F.sum(f"_k_{c}"), F.lit(0)), F.lit(0.0)), 2).alias(c)
    return rows.groupBy("retriever").agg(F.count("*").alias("responses"), F.coalesce(F.sum("_n"), F.lit(0)).alias("ratings"), *[mean(c) for c in CRITERIA])


def recent(responses: DataFrame, ratings: DataFrame, limit: int = 50) -> DataFrame:
    """The last `limit` (held to 1..200) ratings with their responses: a sorted head of each partition, no full sort."""
    rows = ratings.join(responses.select(F.col("id").alias("response_id"), "question", "retriever").distinct(), "response_id")
    return rows.orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(min(200, max(1, limit)))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Questions of 2 to 5000 characters that aren't blank, session ids of 1 to 64."""
    q = strip(F.coalesce("question", F.lit("")))
    return requests.where(F.length(q).between(2, 5000) & F.length("session_id").between(1, 64))


def serialized(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, retrieved): a query's final hits as an array of structs, ranked from 1, with the first score that isn't null; bounded by the final top k."""
    score = F.coalesce(*[F.col(c) for c in ("relevance_score", "score", "base_score") if c in hits.columns])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    row = F.struct("pos", F.coalesce(F.nullif("doc_name", F.lit("")), F.lit("Unknown")).alias("document"), text("chapter").alias("chapter"), text("section").alias("section"), text("subsection_id").alias("subsection_id"), score.alias("score"))
    out = hits.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    ranked = F.transform("_r", lambda x, i: F.struct((i + 1).alias("rank"), x["document"].alias("document"), x["chapter"].alias("chapter"), x["section"].alias("section"), x["subsection_id"].alias("subsection_id"), x["score"].alias("score")))
    return out.select(by, ranked.alias("retrieved"))
