"""Near-duplicate records by meet-in-the-middle ball hashing of min-wise fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.operators.materialize import written

#: Groups of copies equal byte for byte are written out pair by pair up to this size, larger ones as (first, copy) pairs.
EXPAND_COPIES = 32


def shingle_hashes(text: Column, words: int) -> Column:
    """Distinct runs of `words` consecutive words, hashed; lower case, each ASCII character but letters and digits a blank."""
    plain = F.regexp_replace(F.lower(text), r"[\x00-\x7f&&[^a-z0-9]]", " ")
    # a run is hashed from its words' hashes, so no joined string is built
    w = F.transform(F.filter(F.split(plain, r"(?U)\s+"), lambda x: x != ""), lambda x: F.xxhash64(x))
    n = F.size("_w") - (words - 1)
    run = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(words)])
    return w, F.when(n > 0, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), run)))).otherwise(F.array().cast("array<bigint>"))


def within(bits: int, radius: int, differ: float) -> float:
    """Chance that two fingerprints of `bits` bits are within `radius`, each bit differing with probability `differ`."""
    return sum(math.comb(bits, d) * differ**d * (1 - differ) ** (bits - d) for d in range(radius + 1))


#: Low bits of a fingerprint, over which balls are taken, and one-bit min-wise hashes by which pairs are tested before verification.
BALL_BITS, CHECK_WORDS = 8, 3


def ball_plan(rows: int, threshold: float, radius: int = 2, miss: float = 0.0005, bits: int = BALL_BITS) -> tuple[int, int]:
    """(symbols, fingerprints): a fingerprint holds `symbols` whole min-wise hashes, one more for every factor of a million rows, and as many
    fingerprints are taken as a pair exactly at the threshold needs to be missed by all with probability `miss` at most.

    Records without a common run of words share no whole hash, so they never meet, however many records there are; only
    boilerplate makes others meet, and every further symbol makes that rarer by the part of a text that it is.
    """
    symbols = 1 + max(1, math.ceil(math.log(max(2, rows)) / math.log(1e6)))
    found = threshold**symbols * within(bits, radius, (1 - threshold) / 2)
    return symbols, math.ceil(math.log(miss) / math.log(1 - found))


def _fingerprints(symbols: int, count: int, bits: int = BALL_BITS):
    """Arrow batches of (id, shingles) to (id, fps array<long>, check array<long>).

    A fingerprint's high bits are a hash of its number and its whole min-wise hashes, its low `bits` are one bit each of
    further ones. The check words are one bit of every min-wise hash, and of more to fill the words.
    """
    per = symbols + bits
    total = max(per * count, 64 * CHECK_WORDS)
    rng = np.random.default_rng(20)
    mul = rng.integers(0, 2**32, total, np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, total, np.uint64).astype(np.uint32)
    mix = rng.integers(0, 2**64, (symbols, count), np.uint64) | np.uint64(1)
    seat = rng.integers(0, 2**64, count, np.uint64)
    ball = (1 << np.arange(bits, dtype=np.uint64)).reshape(1, bits, 1)
    word = (np.uint64(1) << np.arange(64, dtype=np.uint64)).reshape(1, 1, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            n = len(ids)
            least = np.empty((n, total), np.uint32)
            step = 64  # records at a time, so that the work stays in cache and memory small
            for a in range(0, n, step):
                b = min(n, a + step)
                part = values[offsets[a] : offsets[b]]
                x = ((part >> 17) ^ part).astype(np.uint64).astype(np.uint32)
                at = (offsets[a:b] - offsets[a]).astype(np.int64)
                for j in range(total):
                    least[a:b, j] = np.minimum.reduceat(x * mul[j] + add[j], at)
            low = (least * np.uint32(2654435769)) >> np.uint32(31)
            held = least[:, : per * count].reshape(n, per, count)
            whole = (held[:, :symbols].astype(np.uint64) * mix + seat).sum(axis=1, dtype=np.uint64)
            whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            near = (low[:, : per * count].reshape(n, per, count)[:, symbols:].astype(np.uint64) * ball).sum(axis=1, dtype=np.uint64)
            fps = ((whole >> np.uint64(bits)) << np.uint64(bits) | near).view(np.int64)
            check = (low[:, : 64 * CHECK_WORDS].reshape(n, CHECK_WORDS, 64).astype(np.uint64) * word).sum(axis=2, dtype=np.uint64).view(np.int64)
            rows = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))
            yield pa.RecordBatch.from_arrays([ids, rows(fps), rows(check)], names=["rep", "fps", "check"])

    return run


#: Records of a bucket that meet in one cell. Larger buckets are split into cells; they are looked for among one record in so many.
BUCKET, SAMPLED = 2_000, 16
#: Buckets to be split that go to all tasks, 16 bytes each; more of them are joined in a shuffle.
BROADCAST_BUCKETS = 100_000


def in_cells(variants: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """`variants` (rep, check, key) with the cell (key, lo, hi) of the bucket in which two records meet.

    A bucket of more than some `bucket` records, such as boilerplate makes, is cut into parts, and a record goes to a
    cell for each pair of parts that has its own: any two of the bucket meet in one cell, and no task has more than a
    cell's pairs at a time. Which buckets are large is estimated from a sample of the records; the pairs are the same
    whatever the estimate says.
    """
    sample = variants.where(F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(SAMPLED)) == 0)
    large = sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLED > bucket)
    large = written(large.select("key", F.ceil(F.col("n") * SAMPLED / F.lit(bucket)).cast("int").alias("parts")))
    n = large.count()
    if not n:
        return variants.withColumns({"own": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    parts = F.coalesce("parts", F.lit(1))
    held = variants.join(F.broadcast(large) if n <= BROADCAST_BUCKETS else large, "key", "left")
    held = held.withColumns({"own": F.pmod(F.xxhash64("rep"), parts).cast("int"), "_x": F.sequence(F.lit(0), parts - 1)})
    cell = F.explode(F.transform("_x", lambda x: F.struct(F.least("own", x).alias("lo"), F.greatest("own", x).alias("hi"))))
    return held.select("rep", "check", "key", "own", cell.alias("_c")).select("rep", "check", "key", "own", "_c.lo", "_c.hi")


def near_classes(df: DataFrame, id_col: str, text: Column, words: int = 3, exact: tuple[Column, ...] = ()) -> DataFrame:
    """(id, rep, copies, shingles): records of equal shingle sets form a class, named by its smallest id; `shingles` only in the row of `rep`.

    Among the keys, k3 tells the records of a class apart whose `exact` columns (the text, if none are given) differ in any byte.

    Null and blank texts and texts of fewer words than a run have no row; a record delivered again counts once. A class
    is kept as (member, rep) rows and never gathered: its smallest id is a partial aggregate, however many copies there are.
    """
    words_of, shingles = shingle_hashes(text, words)
    same = F.xxhash64(*[x for c in exact or (text,) for x in (c.isNull(), c)])
    rows = df.select(F.col(id_col).alias("id"), words_of.alias("_w"), same.alias("k3")).select("id", shingles.alias("shingles"), "k3")
    # filtered and keyed only after the table is written: pushed below, the filter would compute the runs again
    rows = written(rows).where(F.size("shingles") > 0).withColumns({"k1": F.xxhash64("shingles"), "k2": F.hash("shingles")})
    keys = rows.groupBy("id", "k1", "k2").agg(F.min("k3").alias("k3"))
    classes = keys.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = rows.join(classes, (rows.id == classes.rep) & (rows.k1 == classes.k1) & (rows.k2 == classes.k2), "left_semi").dropDuplicates(["id"])
    return keys, classes, reps.select(F.col("id").alias("rep"), "shingles")


def similar_pairs(reps: DataFrame, n_reps: int, threshold: float, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with a < b of all class representatives whose shingle sets are alike to `threshold` (Jaccard) or more.

    Each record's fingerprints emit every variant within half the radius in their low bits: two fingerprints of the same
    whole hashes whose low bits are within the radius share one. Records meet on the variant; pairs whose first 64 check
    bits differ too much (4.5 standard deviations beyond what the threshold gives) are left at once, the others
    deduplicated, tested likewise on all check bits, and verified on their whole shingle sets.
    """
    symbols, count = ball_plan(n_reps, threshold, radius)
    signed = written(reps.mapInArrow(_fingerprints(symbols, count), "rep bigint, fps array<bigint>, check array<bigint>"))
    masks = {0}
    for _ in range(radius // 2):
        masks |= {m ^ (1 << j) for m in masks for j in range(BALL_BITS)}
    ball = F.array(*[F.lit(m).cast("long") for m in sorted(masks)])
    keys = F.flatten(F.transform("fps", lambda f: F.transform(ball, lambda m: f.bitwiseXOR(m))))
    variants = in_cells(signed.select("rep", F.get("check", F.lit(0)).alias("check"), F.explode(keys).alias("key")), bucket)
    differ = (1 - threshold) / 2
    furthest = lambda n: math.ceil(n * differ + 4.5 * math.sqrt(n * differ * (1 - differ)))
    # the hint keeps the join from a broadcast: its size is guessed from the table before the variants are made
    a, b = variants.alias("a"), variants.alias("b").hint("merge")
    near = F.bit_count(F.col("a.check").bitwiseXOR(F.col("b.check"))) <= furthest(64)
    own = (F.least("a.own", "b.own") == F.col("a.lo")) & (F.greatest("a.own", "b.own") == F.col("a.hi"))
    cell = (F.col("a.key") == F.col("b.key")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
    met = a.join(b, cell & (F.col("a.rep") < F.col("b.rep")) & near & own)
    met = met.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    # the same test over all bits, a few dozen bytes a record, before whole shingle sets are moved
    side = lambda c: signed.select(F.col("rep").alias(c), F.col("check").alias(f"_c{c}"))
    apart = sum((F.bit_count(F.get("_ca", F.lit(i)).bitwiseXOR(F.get("_cb", F.lit(i)))) for i in range(CHECK_WORDS)), F.lit(0))
    met = met.join(side("a"), "a").join(side("b"), "b").where(apart <= furthest(64 * CHECK_WORDS)).select("a", "b")
    pairs = met.join(reps.select(F.col("rep").alias("a"), F.col("shingles").alias("_x")), "a").join(reps.select(F.col("rep").alias("b"), F.col("shingles").alias("_y")), "b")
    both = F.size(F.array_intersect("_x", "_y"))
    alike = both / (F.size("_x") + F.size("_y") - both)
    return pairs.select("a", "b", alike.alias("likeness")).where(F.col("likeness") >= threshold)


def near_pairs(df: DataFrame, id_col: str, text: Column, threshold: float = 0.7, words: int = 3, expand: int = EXPAND_COPIES, exact: tuple[Column, ...] = ()) -> DataFrame:
    """(record_a, record_b), a < b: all pairs of records alike to `threshold` or more.

    Different texts are linked one by one, those of a class of equal shingle sets too: its members have the same links.
    Only of more than `expand` records that are equal byte for byte in the `exact` columns (the text, if none are given),
    the smallest id alone carries the links to other texts and each copy is tied to that id, which says the same without a
    quadratic number of rows.
    """
    keys, classes, reps = near_classes(df, id_col, text, words, exact)
    reps = written(reps)
    pairs = similar_pairs(reps, reps.count(), threshold)
    big = keys.join(classes.where(F.col("copies") > expand), ["k1", "k2"], "left_semi")
    copied = big.groupBy("k1", "k2", "k3").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") > expand).drop("n")
    inner = keys.join(classes.where(F.col("copies") > 1), ["k1", "k2"]).join(copied, ["k1", "k2", "k3"], "left")  # only of classes that have copies
    members = inner.where(F.col("first").isNull() | (F.col("id") == F.col("first"))).select("rep", F.col("id").alias("member"))
    side = lambda p, c: p.join(members.select(F.col("rep").alias(c), "member"), c, "left").withColumn(c, F.coalesce("member", c)).drop("member")
    across = side(side(pairs.select("a", "b"), "a"), "b")
    m = members.alias("x").join(members.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.member") < F.col("y.member")))
    inside = m.select(F.col("x.member").alias("a"), F.col("y.member").alias("b"))
    large = inner.where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    every = across.unionByName(inside).unionByName(large)
    return every.select(F.least("a", "b").alias("record_a"), F.greatest("a", "b").alias("record_b"))


def near_groups(df: DataFrame, id_col: str, text: Column, threshold: float = 0.7, words: int = 3, rounds: int = 30) -> DataFrame:
    """(id, class_id, group_id, links): each record with text, its class of equal shingle sets, the group it is linked into, and its class's links.

    Groups are the connected components of the links between classes, named by their smallest id. Labels fall to the least
    label among neighbours and then jump to their label's label, so the rounds grow with the logarithm of the longest
    chain; each round is written to the shared folder. Records without links are groups of their own.
    """
    keys, classes, reps = near_classes(df, id_col, text, words)
    reps = written(reps)
    pairs = written(similar_pairs(reps, reps.count(), threshold).select("a", "b"))
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("links")))
    for _ in range(rounds):
        seen = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, "a").select("a", "links", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("far"))
        step = written(step.join(jump, "label", "left").select("a", "links", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = step.drop("old")
        if step.where(F.col("old") != F.col("label")).isEmpty():
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    out = keys.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).join(labels.withColumnRenamed("a", "rep"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
