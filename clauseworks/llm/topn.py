"""The N highest-scoring rows of every group, taken from descending score bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.operators.materialize import written

#: Share of all rows at or above the lower edge of each band but the last: small bands first, as they fill most large groups.
BAND_SHARES = (1 / 64, 1 / 8)
#: Group keys that an anti-join may broadcast (some 10 MB); beyond, keys are replicated over salts instead.
BROADCAST_GROUPS = 100_000
SALTS = 16


def _without_filled(rows: DataFrame, filled: DataFrame, n_filled: int) -> DataFrame:
    """Anti-join the filled groups. A shuffled join would put a hot group into one task, so its rows are salted."""
    if n_filled == 0:
        return rows
    if n_filled <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(filled), "_g", "left_anti")
    salted = filled.select("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_t"), F.lit(SALTS))).join(salted, ["_g", "_salt"], "left_anti").drop("_salt")


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int = 5, shares: tuple[float, ...] = BAND_SHARES) -> DataFrame:
    """(group, tie, score, rank) of the `n` rows with the highest score in each group, the smaller `tie` first.

    The rows are laid down once as range-partitioned score bands. Bands are processed from the top: groups that are
    already filled are anti-joined away, the others take what they still need, and ties at the boundary are ranked
    exactly by (score desc, tie). Every band's rank is limited on the map side first, so no task ever holds a group.
    Rows with a null group, null score or NaN score are not ranked; equal (group, tie, score) rows count once; groups
    with fewer rows give all. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("_g"), F.col(tie).alias("_t"), F.col(score).cast("double").alias("_s"))
    rows = rows.where(F.col("_g").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))
    edges = sorted({-x for x in rows.select((-F.col("_s")).alias("m")).approxQuantile("m", list(shares), 0.002)}, reverse=True)
    band = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        band = F.when(F.col("_s") >= edge, i).otherwise(band)
    bands = written(rows.withColumn("_band", band.cast("int")), "_band")

    best = Window.partitionBy("_g").orderBy(F.col("_s").desc(), F.col("_t"))
    state, filled, n_filled = None, None, 0
    for i in range(len(edges) + 1):
        here = bands.where(F.col("_band") == i).drop("_band")
        if n_filled:
            here = _without_filled(here, filled, n_filled)
        # dense_rank gives copies of a row one rank, so deliveries of the same row take no second place
        ranked = here.withColumn("_r", F.dense_rank().over(best)).where(F.col("_r") <= n).distinct()
        if state is not None:
            have = state.groupBy("_g").agg(F.count("*").alias("_have"))
            ranked = ranked.join(have, "_g", "left").withColumn("_r", F.col("_r") + F.coalesce("_have", F.lit(0))).drop("_have").where(F.col("_r") <= n)
        ranked = ranked.withColumn("_r", F.col("_r").cast("int"))
        if i == len(edges):
            state = ranked if state is None else state.unionByName(ranked)
            break
        taken = written(ranked)
        state = taken if state is None else state.unionByName(taken)
        filled = state.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select("_g")
        n_filled = filled.count()
    return state.select(F.col("_g").alias(group), F.col("_t").alias(tie), F.col("_s").alias(score), F.col("_r").alias("rank"))
