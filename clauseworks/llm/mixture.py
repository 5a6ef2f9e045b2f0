"""A mixture of sources at target shares, ordered by a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.llm.tokens import TOKENIZER, sized
from clauseworks.operators.materialize import written

#: Documents in a slice of a source; prefix sums run over slices first, then inside each, so no task holds a source.
DOCS_PER_SLICE = 20_000
#: Targets that go to all tasks, some 60 bytes each; more of them meet the documents in a shuffle.
BROADCAST_TARGETS = 100_000


def inverse_demand(x: Column, slope: Column) -> Column:
    """The time t in [0, 1] at which a source of linear schedule share * (1 + slope * (2t - 1)) has met part x of its demand.

    Its cumulative demand is x = t + slope * (t² - t); solved for t.
    """
    a, b = slope, F.lit(1.0) - slope
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    root = F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * a * x))
    return F.when(F.abs(a) < 1e-9, x).otherwise((root - b) / (2 * a))


def position_at(time: Column, drift: Column) -> Column:
    """The part of the mixture's tokens that are asked for until a time.

    The schedules of all sources add up to 1 + drift * (2t - 1), `drift` being their slopes weighted by tokens. Counted in
    tokens asked for instead of time, each source's weight is its schedule by their sum, so the weights add up to 1 everywhere.
    """
    return time + drift * (time * time - time)


def plan(sizes: DataFrame, targets: DataFrame, source_col: str = "source", slopes: dict[str, float] | None = None) -> DataFrame:
    """One row per target: (source, target_share, max_repeats, source_tokens, total_tokens, demand, used_tokens, slope, drift, reachable).

    The total is that of all documents, those without a source or target included. A source's demand is its share of the
    total; it supplies its tokens times its repeats. A source without documents supplies nothing. Targets with a null
    share or repeats count as 0; targets delivered again count once.
    """
    # partial sums on the map side; what is left is one row per source, joined with the targets' few rows
    held = sizes.groupBy(source_col).agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0  # one number
    goals = targets.select(source_col, F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    goals = goals.where(F.col(source_col).isNotNull()).distinct()
    known = goals.join(held, source_col, "left").withColumn("total_tokens", F.lit(total).cast("long"))
    supply = F.col("source_tokens") * F.col("max_repeats")
    demand = F.col("target_share") * F.col("total_tokens")
    slope = F.lit(0.0)
    for name, value in (slopes or {}).items():
        slope = F.when(F.col(source_col) == name, F.lit(float(value))).otherwise(slope)
    known = known.withColumns({"source_tokens": F.coalesce("source_tokens", F.lit(0)), "source_docs": F.coalesce("source_docs", F.lit(0))})
    known = written(known.withColumns({"demand": demand, "used_tokens": F.least(demand, supply.cast("double")), "slope": slope, "reachable": supply >= demand}))
    used, leant = known.agg(F.sum("used_tokens"), F.sum(F.col("used_tokens") * F.col("slope"))).first()  # two numbers
    return known.withColumn("drift", F.lit(leant / used if used else 0.0))


def arrange(sizes: DataFrame, goals: DataFrame, id_col: str = "doc_id", docs_per_slice: int = DOCS_PER_SLICE) -> DataFrame:
    """(id, source, repeat, n_tokens, position): the uses of every document, due at `position` in [0, 1].

    Each source's weight schedule is integrated to its cumulative token demand. A source's documents stand in hash order;
    the use that covers tokens [c, c + n) of its demand is due when c + n/2 of it has been asked for, found by inverting
    the demand; its position is counted in tokens of the mixture. Sources repeat whole passes until demand or `max_repeats` ends them; a use is kept if its middle is
    within the demand, so a source is off by half a document at most. Texts without tokens, texts without source and
    sources without target are left out.
    """
    few = goals.count() <= BROADCAST_TARGETS
    each = goals.select("source", "max_repeats", "used_tokens", "source_tokens", "slope", "drift", "source_docs")
    rows = sizes.where(F.col("n_tokens") > 0).join(F.broadcast(each) if few else each, "source")
    slices = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / docs_per_slice)).cast("int")
    rows = rows.withColumn("_h", F.xxhash64(id_col)).withColumn("_slice", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * slices).cast("int"))
    per = rows.groupBy("source", "_slice").agg(F.sum("n_tokens").alias("_mass"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "_slice", F.coalesce(F.sum("_mass").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_slice").orderBy("_h", id_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(per, ["source", "_slice"]).withColumn("_at", F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    middle = F.col("_at") + F.col("n_tokens") / 2
    uses = F.ceil((F.col("used_tokens") - middle) / F.col("source_tokens")).cast("int")
    rows = rows.withColumn("_uses", F.least(F.col("max_repeats"), F.greatest(F.lit(0), uses))).where(F.col("_uses") > 0)
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("_uses"))))
    due = ((F.col("repeat") - 1) * F.col("source_tokens") + middle) / F.col("used_tokens")
    return rows.select(id_col, "source", "repeat", "n_tokens", position_at(inverse_demand(due, F.col("slope")), F.col("drift")).alias("position"))


def mixture(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", slopes: dict[str, float] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """The arranged uses, range-sorted by position: the order in which to train."""
    sizes = written(sized(df, id_col, text_col, "source", path=tokenizer))
    return arrange(sizes, plan(sizes, targets, slopes=slopes), id_col).orderBy("position", id_col, "repeat")


def short_sources(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", slopes: dict[str, float] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Sources whose documents, used as often as allowed, hold fewer tokens than their target.

    In the arranged mixture they are used up; as the last use of a source may end beyond its demand, the used-up sources
    are then held exactly against their targets.
    """
    sizes = written(sized(df, id_col, text_col, "source", path=tokenizer))
    goals = plan(sizes, targets, slopes=slopes)
    got = arrange(sizes, goals, id_col).groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    used_up = F.coalesce("tokens", F.lit(0)) >= F.col("source_tokens") * F.col("max_repeats")
    return goals.join(got, "source", "left").where(used_up & ~F.col("reachable")).select("source")


def shares(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", slopes: dict[str, float] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """What a mixture really reaches: (source, target_share, max_repeats, tokens, most_repeats, share_of_target_total, share_of_mixture).

    The first share is of all documents' tokens, to which the targets refer; the second is of the mixture as it comes
    out, which is smaller where sources fall short. A target without documents has 0.
    """
    sizes = written(sized(df, id_col, text_col, "source", path=tokenizer))
    goals = plan(sizes, targets, slopes=slopes)
    got = arrange(sizes, goals, id_col).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("repeat").alias("most_repeats"))
    out = goals.select("source", "target_share", "max_repeats", "total_tokens").join(got, "source", "left")
    mixed = F.sum("tokens").over(Window.partitionBy())  # one row per target
    part = lambda whole: F.coalesce(F.col("tokens") / F.when(whole > 0, whole), F.lit(0.0))
    return out.select(
        "source", "target_share", "max_repeats",
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        part(F.col("total_tokens")).alias("share_of_target_total"), part(mixed).alias("share_of_mixture"),
    )
