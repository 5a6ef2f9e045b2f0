"""Vector expressions and the block kernel of exact search."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for null, empty or unequally long vectors and for a zero norm."""
    fit = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    length = norm(a) * norm(b)
    return F.when(fit, F.coalesce(dot(a, b) / F.when(length > 0, length), F.lit(0.0))).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def decode_int8(values: Column) -> Column:
    """Base64 of signed bytes as floats."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: None if v is None else np.frombuffer(base64.b64decode(v), np.int8).astype(np.float32))

    return run(values)


#: Bytes of query vectors that go to all tasks at once; a larger query set is taken in further blocks, each one more scan of the vectors.
QUERY_BYTES = 16 << 20
#: Queries that a task multiplies with a batch at a time, so that the products stay small.
QUERIES_AT_ONCE = 512
#: Vectors of a batch that are multiplied at a time.
VECTORS_AT_ONCE = 2_000


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, same: str | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, score, rank) of the `k` most similar vectors of each query, ties by the smaller id.

    `queries` has query_id and vector, `vectors` id and vector, both also `same` if only vectors with the query's value of
    it may be hit. The query set goes to all tasks as a matrix of bounded size. Each task multiplies its Arrow batches
    with it and keeps the best k of every query while it reads, so k rows per query and task are shuffled, never pairs.
    Scores are rounded to 6 places before they are compared. Null and zero vectors, such with null elements and such of
    another length score 0; null ids are left out, and so are null values of `same`.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    cols = ["query_id", "vector", *([same] if same else [])]
    asked = queries.select(*cols).where(F.col("query_id").isNotNull())
    total, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, min(total, -(-total * 8 * max(1, size) // query_bytes)))
    id_type, query_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rows = vectors.select("id", "vector", *([same] if same else [])).where(F.col("id").isNotNull())
    rows = rows.coalesce(2 * vectors.sparkSession.sparkContext.defaultParallelism)  # so that what tasks keep doesn't grow with the vectors
    hits = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        hits.append(rows.mapInArrow(_block_kernel(block.toArrow(), k, same, vectors.sparkSession), f"query_id {query_type}, id {id_type}, score double"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return reduce(DataFrame.unionByName, hits).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _matrix(lists: pa.ListArray, size: int) -> np.ndarray:
    """One row per list; zeros for lists that are null, of another length or have null elements."""
    n, lists = len(lists), lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values, lengths = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == size).all():
        out = flat.reshape(n, size)
    else:
        out, fit = np.zeros((n, size)), lengths == size
        out[fit] = flat[np.repeat(fit, lengths)].reshape(-1, size)
    bad = ~np.isfinite(out).all(axis=1) if size else np.zeros(n, bool)
    return np.where(bad[:, None], 0.0, out) if bad.any() else out


def _block_kernel(queries: pa.Table, k: int, same: str | None, spark):
    lists = queries.column("vector")
    size = pc.max(pc.list_value_length(lists)).as_py() or 0
    matrix = _matrix(lists, size)
    lengths = np.linalg.norm(matrix, axis=1)
    if lists.type.value_type == pa.float32():
        matrix = matrix.astype(np.float32)  # as they came; products in double are the same
    # Products are taken in single precision first; what that (size x 2^-24 at most, on both sides of a comparison) and rounding to 6 places may change is let through, and scored in double.
    slack = 1e-6 + (size + 4) * 2.0**-23
    shared = spark.sparkContext.broadcast((matrix, lengths, queries.column("query_id").combine_chunks(), queries.column(same).combine_chunks().unique() if same else None, queries.column(same).combine_chunks() if same else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, lengths, ids, labels, own = shared.value
        if not len(ids):
            return
        wanted = pc.index_in(own, labels, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False) if same else None
        starts = range(0, len(ids), QUERIES_AT_ONCE)
        held, held_ids = [(np.empty(0, np.int64), np.empty(0)) for _ in starts], [None for _ in starts]  # queries and scores, ids kept so far
        fresh = [[] for _ in starts]  # the same of what was found since
        least = np.full(len(ids), -np.inf)  # the k-th best score of a query so far
        unit = lambda m, norms: np.divide(m, norms[:, None], out=np.zeros(m.shape), where=norms[:, None] > 0).astype(np.float32)
        asked = np.empty(matrix.shape, np.float32)
        for a in starts:
            asked[a : a + QUERIES_AT_ONCE] = unit(matrix[a : a + QUERIES_AT_ONCE], lengths[a : a + QUERIES_AT_ONCE])

        zero = np.flatnonzero(lengths == 0) if not same else np.empty(0, np.int64)  # all vectors score 0 there, so the smallest ids are the best
        blank, smallest = np.isin(np.arange(len(ids)), zero), None

        def merge(i: int) -> None:
            """By query, best score, smaller id; the first k of each query stay."""
            every = pa.concat_arrays([*([] if held_ids[i] is None else [held_ids[i]]), *[x[2] for x in fresh[i]]])
            qs, ss = (np.concatenate([held[i][c], *[x[c] for x in fresh[i]]]) for c in (0, 1))
            order = np.lexsort((pc.rank(every, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False), -ss, qs))
            qs, ss = qs[order], ss[order]
            first = np.r_[0, np.flatnonzero(np.diff(qs)) + 1]
            place = np.arange(len(qs)) - np.repeat(first, np.diff(np.r_[first, len(qs)]))
            stay = place < k
            held[i], held_ids[i], fresh[i] = (qs[stay], ss[stay]), every.take(pa.array(order[stay])), []
            full = place == k - 1
            least[i * QUERIES_AT_ONCE + qs[full]] = ss[full]

        for batch in (batch.slice(i, VECTORS_AT_ONCE) for batch in batches for i in range(0, batch.num_rows, VECTORS_AT_ONCE)):
            n = batch.num_rows
            v = _matrix(batch.column(1), matrix.shape[1])
            norms = np.linalg.norm(v, axis=1)
            near = unit(v, norms)
            if len(zero):
                smallest = batch.column(0) if smallest is None else pa.concat_arrays([smallest, batch.column(0)])
                smallest = smallest.take(pc.sort_indices(smallest)[:k])
            mine = pc.index_in(batch.column(2), labels, skip_nulls=True).fill_null(-2).to_numpy(zero_copy_only=False) if same else None
            for i, a in enumerate(starts):
                b = min(len(ids), a + QUERIES_AT_ONCE)
                score = near @ asked[a:b].T
                if same:
                    score[(mine[:, None] != wanted[None, a:b]) | (mine[:, None] < 0)] = -np.inf
                floor, few = least[a:b].copy(), np.flatnonzero(np.isneginf(least[a:b]) & ~blank[a:b])  # queries without k hits so far
                floor[blank[a:b]] = np.inf
                if n > k and len(few):
                    floor[few] = np.partition(score[:, few], n - k, axis=0)[n - k]
                at, q = np.divmod(np.flatnonzero(score >= np.maximum(floor - slack, -2).astype(np.float32)), b - a)  # cosines are -1 at least
                if not len(at):
                    continue
                scale = norms[at] * lengths[a + q]
                exact = np.divide(np.einsum("ij,ij->i", v[at], matrix[a + q]), scale, out=np.zeros_like(scale), where=scale > 0)
                fresh[i].append((q, np.round(exact, 6), batch.column(0).take(pa.array(at))))
                if len(few) or sum(len(x[0]) for x in fresh[i]) >= (b - a) * k // 2:
                    merge(i)
        for i in range(len(starts)):
            if fresh[i]:
                merge(i)
        for a, (qs, ss), kept in zip(starts, held, held_ids):
            if kept is not None:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(qs + a)), kept, pa.array(ss)], names=["query_id", "id", "score"])
        for a in range(0, len(zero) if smallest is not None else 0, QUERIES_AT_ONCE):
            q, n = zero[a : a + QUERIES_AT_ONCE], len(smallest)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(q, n))), smallest.take(pa.array(np.tile(np.arange(n), len(q)))), pa.array(np.zeros(n * len(q)))], names=["query_id", "id", "score"])
        pa.default_memory_pool().release_unused()  # the process stays for other tasks

    return run
