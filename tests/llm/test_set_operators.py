"""Near-duplicates, top N, packing and mixing against brute force and their own guarantees."""

import random

import pytest
from pyspark.sql import functions as F

from clauseworks.llm import mixture, neardup, packing, topn


def shingles(t, k=3):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_near_pairs_agree_with_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            n += 1
            rows.append((n, " ".join(t)))
    rows += [(900, "too short"), (901, None), (902, ""), rows[0]]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("rep", F.lit("clash")).withColumn("key", F.lit(0))
    got = {tuple(r) for r in neardup.near_pairs(df, "id", F.col("t")).collect()}
    sets = {i: shingles(t) for i, t in rows if t and len(t.split()) > 2}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert len(want) > 40 and got <= want and len(got) >= 0.98 * len(want)
    groups = {r.id: r.group_id for r in neardup.near_groups(df, "id", F.col("t")).collect()}
    assert groups.keys() == sets.keys() and all(groups[a] == groups[b] for a, b in got)


def test_many_copies_are_tied_to_their_first(spark):
    rows = [(i, "one two three four five six") for i in range(1, 101)] + [(200, "seven eight nine ten eleven")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {tuple(r) for r in neardup.near_pairs(df, "id", F.col("t"), expand=32).collect()}
    assert got == {(1, i) for i in range(2, 101)}
    assert neardup.near_pairs(df.limit(0), "id", F.col("t")).count() == 0


def test_different_texts_of_a_large_class_are_all_linked(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(i, " ".join(w.upper() if i >> j & 1 else w for j, w in enumerate(words))) for i in range(1, 41)] + [(100 + i, " ".join(words)) for i in range(40)] + [(200, " ".join(words + ["thirteen"]))]
    rows += rows[:3]
    got = {tuple(r) for r in neardup.near_pairs(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t")).collect()}
    linked = [*range(1, 41), 100, 200]  # the 40 byte-equal ones are tied to 100, their first
    assert got == {(a, b) for a in linked for b in linked if a < b} | {(100, 100 + i) for i in range(1, 40)}


def test_ball_plan_keeps_its_recall_and_stays_small():
    variants = []
    for n in (10, 10_000, 10**6, 10**9, 10**12):
        symbols, count = neardup.ball_plan(n, 0.7)
        found = 0.7**symbols * neardup.within(neardup.BALL_BITS, 2, 0.15)
        assert (1 - found) ** count <= 0.0005
        variants.append(count * (neardup.BALL_BITS + 1))
    assert variants == sorted(variants) and variants[-1] <= 350


def test_fingerprints_meet_as_planned():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    symbols, count = neardup.ball_plan(1000, 0.7)
    met = []
    for _ in range(150):  # pairs of a likeness of 140 / 200
        same, own = rng.integers(-(2**62), 2**62, 140), rng.integers(-(2**62), 2**62, 60)
        lists = pa.array([np.sort(np.r_[same, own[:30]]), np.sort(np.r_[same, own[30:]])], pa.list_(pa.int64()))
        (out,) = neardup._fingerprints(symbols, count)([pa.RecordBatch.from_arrays([pa.array([1, 2]), lists], names=["rep", "shingles"])])
        x, y = (np.array(v, np.int64).view(np.uint64) for v in out.column(1).to_pylist())
        met.append(any(int(d).bit_count() <= 2 and d < 256 for d in x ^ y))
    assert np.mean(met) >= 0.97


def test_split_buckets_give_the_same_pairs(spark):
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join(shared[: rng.randint(20, 40)] + [f"w{rng.randrange(30)}" for _ in range(rng.randint(4, 20))])) for i in range(300)]
    keys, classes, reps = neardup.near_classes(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"))
    reps = neardup.written(reps)
    got = [{tuple(r) for r in neardup.similar_pairs(reps, 300, 0.7, bucket=b).select("a", "b").collect()} for b in (2_000, 16)]
    sets = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert got[0] == got[1] and got[0] <= want and len(got[0]) >= 0.98 * len(want) > 100


@pytest.mark.parametrize("groups_broadcast", [True, False])
def test_top_n_agrees_with_brute_force(spark, monkeypatch, groups_broadcast):
    if not groups_broadcast:
        monkeypatch.setattr(topn, "BROADCAST_GROUPS", 0)
    rng = random.Random(1)
    rows = [(f"g{rng.choice((0, 0, 0, 0, rng.randrange(80)))}", i, rng.choice((0.1, 0.5, 0.9, 0.9, rng.random()))) for i in range(3000)]
    rows += rows[:300] + [(None, 5000, 1.0), ("g1", 5001, None), ("g1", 5002, float("nan")), ("low", 5003, -1.0)]
    df = spark.createDataFrame(rows, "section string, result_id long, score double").withColumn("_band", F.lit(9))
    got = {tuple(r) for r in topn.top_n(df, "section", "score", "result_id").select("section", "result_id", "rank").collect()}
    want = set()
    for g in {r[0] for r in rows if r[0]}:
        best = sorted({(-s, i) for x, i, s in rows if x == g and s is not None and s == s})[:5]
        want |= {(g, i, k + 1) for k, (_, i) in enumerate(best)}
    assert got == want
    assert topn.top_n(df.limit(0), "section", "score", "result_id").count() == 0


DOCS = "doc_id long, text string, source string, n_tokens string"


def test_packing_holds_capacity_and_divides_only_what_must_be(spark):
    rng = random.Random(2)
    rows = [(i, "word " * min(250, int(rng.expovariate(0.02)) + 1), "s", "x") for i in range(400)] + [(900, None, "s", "x"), (901, "", "s", "x"), (902, "word " * 700, "s", "x")]
    packed = packing.pack(spark.createDataFrame(rows + rows[:5], DOCS), capacity=256, containers_per_shard=40).toPandas()
    load = packed.groupby(["shard", "container"]).n_tokens.sum()
    assert load.max() <= 256 and load.mean() >= 0.93 * 256
    assert set(packed[packed.n_parts > 1].doc_id) == {902} and packed[packed.doc_id == 902].n_tokens.sum() >= 700
    assert not packed.duplicated(["doc_id", "part"]).any() and {900, 901}.isdisjoint(packed.doc_id)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_mixture_shares_repeats_and_order(spark):
    rows = [(i, "some words of text here " * 4, "big", "x") for i in range(300)] + [(1000 + i, "some words of text here " * 4, "small", "x") for i in range(20)] + [(2000, "none", None, "x"), (2001, None, "big", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    goals = spark.createDataFrame([("big", 0.5, 1), ("small", 0.25, 3), ("absent", 0.25, 9), ("small", 0.25, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    assert {r.source for r in mixture.short_sources(docs, goals).collect()} == {"small", "absent"}
    mixed = mixture.mixture(docs, goals, slopes={"big": 0.5, "small": -0.9}).toPandas()
    assert mixed.position.is_monotonic_increasing and mixed.position.between(0, 1).all()
    assert mixed[mixed.source == "small"].repeat.max() == 3 and mixed[mixed.source == "big"].repeat.max() == 1
    assert not mixed.duplicated(["doc_id", "repeat"]).any()
    big = mixed[mixed.source == "big"].position
    assert (big > 0.5).mean() > 0.57  # the weight of a rising schedule lies late
    share = {r.source: r.share_of_target_total for r in mixture.shares(docs, goals).collect()}
    assert abs(share["big"] - 0.5) < 0.01 and abs(share["small"] - 60 / 320) < 0.01 and share["absent"] == 0


def test_slices_give_the_same_mixture(spark):
    sizes = spark.createDataFrame([(i, "a", 1 + i % 7) for i in range(500)], "doc_id long, source string, n_tokens long")
    goals = mixture.plan(sizes, spark.createDataFrame([("a", 0.7, 2)], "source string, target_share double, max_repeats int"))
    one, many = (mixture.arrange(sizes, goals, docs_per_slice=n).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (10_000, 13))
    assert one.equals(many)


def test_registered_mixture_follows_the_schedules(spark):
    from clauseworks.llm import queries

    root = "/root/testdata/sf0.01"
    pytest.importorskip("os").path.exists(root) or pytest.skip("no test tables here")
    assert queries.SLOPES.keys() == {r.source for r in queries.table(spark, root, "mix_targets").select("source").distinct().collect()}
    docs, targets = queries.table(spark, root, "documents"), queries.table(spark, root, "mix_targets")
    drift = mixture.plan(mixture.sized(docs, "doc_id", "text", "source"), targets, slopes=queries.SLOPES).first().drift
    rows = queries.p7_mixture(spark, root).groupBy("source").agg((F.sum(F.col("position") * F.col("n_tokens")) / F.sum("n_tokens")).alias("mean"), F.count("*").alias("n")).where("n >= 30").collect()
    assert len(rows) >= 5 and all(abs(r["mean"] - (0.5 + (queries.SLOPES[r.source] - drift) / 6)) < 0.02 for r in rows)  # the mean position of a linear schedule


def test_weights_add_up_at_every_position(spark):
    """Of each tenth of the mixture, sources have the parts that their schedules have of the schedules' sum, and positions are tokens."""
    sizes = spark.createDataFrame([(i, "abc"[i % 3], 10) for i in range(6000)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.2, 1), ("c", 0.3, 1)], "source string, target_share double, max_repeats int")
    slopes = {"a": 0.9, "b": -0.5, "c": 0.2}
    mixed = mixture.arrange(sizes, mixture.plan(sizes, targets, slopes=slopes)).toPandas().sort_values("position")
    assert abs(mixed.position.to_numpy() - [(i + 0.5) / len(mixed) for i in range(len(mixed))]).max() < 0.01
    drift = (0.3 * 0.9 - 0.2 * 0.5 + 0.3 * 0.2) / 0.8
    for k in range(10):
        part = mixed[(mixed.position >= k / 10) & (mixed.position < (k + 1) / 10)].source.value_counts(normalize=True)
        p = (k + 0.5) / 10
        t = p if abs(drift) < 1e-9 else ((drift - 1) + ((1 - drift) ** 2 + 4 * drift * p) ** 0.5) / (2 * drift)
        whole = sum(w * (1 + slopes[s] * (2 * t - 1)) for s, w in (("a", 0.3), ("b", 0.2), ("c", 0.3)))
        for s, w in (("a", 0.3), ("b", 0.2), ("c", 0.3)):
            assert abs(part[s] - w * (1 + slopes[s] * (2 * t - 1)) / whole) < 0.03


def test_many_targets_meet_in_a_shuffle(spark, monkeypatch):
    sizes = spark.createDataFrame([(i, "ab"[i % 2], 5) for i in range(200)], "doc_id long, source string, n_tokens long")
    goals = mixture.plan(sizes, spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 1)], "source string, target_share double, max_repeats int"))
    one = {tuple(r) for r in mixture.arrange(sizes, goals).collect()}
    monkeypatch.setattr(mixture, "BROADCAST_TARGETS", 0)
    assert {tuple(r) for r in mixture.arrange(sizes, goals).collect()} == one


def test_short_sources_come_from_the_arranged_mixture(spark, monkeypatch):
    seen, arrange = [], mixture.arrange
    monkeypatch.setattr(mixture, "arrange", lambda *a, **k: seen.append(1) or arrange(*a, **k))
    docs = spark.createDataFrame([(i, "some words of text here", s, "x") for i, s in enumerate(["a"] * 10 + ["b"] * 10 + ["c"] * 20)], DOCS)
    goals = spark.createDataFrame([("a", 0.25, 1), ("b", 0.26, 1), ("c", 0.4, 1), ("none", 0.05, 5), ("zero", 0.0, 5)], "source string, target_share double, max_repeats int")
    assert {r.source for r in mixture.short_sources(docs, goals, slopes={"a": 0.5}).collect()} == {"b", "none"} and seen
