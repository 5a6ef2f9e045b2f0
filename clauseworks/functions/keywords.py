"""The kernel of keyword search: running best k of every asked list of terms while documents are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PLACES = 6
#: Lists whose hits of a batch are gathered before they are cut to k.
LISTS_AT_ONCE = 256
#: A term in more than this part of a batch's documents is added as a whole column.
DENSE = 0.25
#: One in more than this part has its column kept for a batch, so that candidates are looked up in it.
KEPT = 0.02
#: Documents of a task's first slices, whose k-th best scores bound the work on later ones, and of those.
FIRST_SLICES, SLICE = (1_000, 3_000), 6_000


def keyword_top_k(lists: pa.Table, post: DataFrame, average: float, k: int, k1: float, b: float) -> DataFrame:
    """(list_no, id, score): the best k documents of each list that every task has seen, rounded scores above 0, ties by the smaller id.

    `lists` has list_no and bag, an array of (term, weight); `post` id and terms, all tokens of a document. A document's score is
    the sum over the list's terms of weight x tf (k1 + 1) / (tf + k1 (1 - b + b dl / average)). Only the k best of a list and
    task leave the task, never all pairs of lists and documents. Documents are scored that have one of a list's leading
    terms: what the others add at most in a batch is below the list's k-th best score so far, so no other one can enter.
    """
    bags = lists.column("bag").combine_chunks()
    terms, weights = bags.flatten().field("term"), bags.flatten().field("weight").to_numpy(zero_copy_only=False)
    vocabulary = terms.unique()
    ends = np.r_[0, np.cumsum(pc.list_value_length(bags).to_numpy(zero_copy_only=False))]
    codes = pc.index_in(terms, vocabulary).to_numpy(zero_copy_only=False)
    shared = post.sparkSession.sparkContext.broadcast((lists.column("list_no").to_numpy(), vocabulary, ends, codes, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, vocabulary, ends, codes, weights = shared.value
        starts = range(0, len(numbers), LISTS_AT_ONCE)
        held, held_ids = [(np.empty(0, np.int64), np.empty(0)) for _ in starts], [None for _ in starts]  # lists and scores, ids kept so far
        fresh = [[] for _ in starts]  # the same of what was found since
        least = np.zeros(len(numbers))  # the k-th best score of a list so far
        slack = 10.0**-PLACES  # what rounding may add

        def merge(i: int) -> None:
            """By list, best score, smaller id; the first k of each list stay."""
            every = pa.concat_arrays([*([] if held_ids[i] is None else [held_ids[i]]), *[x[2] for x in fresh[i]]])
            q, score = (np.concatenate([held[i][c], *[x[c] for x in fresh[i]]]) for c in (0, 1))
            order = np.lexsort((pc.rank(every, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False), -score, q))
            order = order[score[order] > 0]
            q, score = q[order], score[order]
            first = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) if len(q) else q
            stay = place < k
            held[i], held_ids[i], fresh[i] = (q[stay], score[stay]), every.take(pa.array(order[stay])), []
            full = place == k - 1
            least[i * LISTS_AT_ONCE + q[full]] = score[full]

        entry_list = np.repeat(np.arange(len(numbers)), np.diff(ends))
        for batch in _slices(batches):
            n = batch.num_rows
            if not n:
                continue
            length = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(batch.column(1).flatten(), vocabulary), -1).to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(code >= 0)
            pair, tf = np.unique(code[asked] * np.int64(n) + np.repeat(np.arange(n), length)[asked], return_counts=True)
            doc = pair % n
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / average))
            edge = np.searchsorted(pair, np.arange(len(vocabulary) + 1) * np.int64(n))
            column: dict[int, np.ndarray] = {}

            def whole(t: int) -> np.ndarray:
                if t not in column:
                    column[t] = np.zeros(n)
                    column[t][doc[edge[t] : edge[t + 1]]] = part[edge[t] : edge[t + 1]]
                return column[t]

            cut = np.maximum(least - slack, slack / 4)  # what a document must have to enter a list
            there = np.flatnonzero(np.diff(edge))
            most = np.zeros(len(vocabulary))
            if len(there):
                most[there] = np.maximum.reduceat(part, edge[there])
            bound = np.maximum(weights, 0) * most[codes]
            order = np.lexsort((bound, entry_list))
            sums = np.cumsum(bound[order])
            before = np.r_[0.0, sums][ends[:-1]]  # of the lists before
            leads = np.zeros(len(codes), bool)
            leads[order] = sums - before[entry_list] >= cut[entry_list]
            leads &= bound > 0
            found = np.bincount(entry_list, np.where(leads, np.diff(edge)[codes], 0), len(numbers))
            total, mark = np.zeros(n), np.zeros(n, bool)
            for i, a in enumerate(starts):
                qs, rows, scores = [], [], []
                for q in (a + np.flatnonzero(found[a : a + LISTS_AT_ONCE])).tolist():
                    own = slice(ends[q], ends[q + 1])
                    asks = list(zip(codes[own].tolist(), weights[own].tolist()))
                    if found[q] > n * DENSE:
                        for t, weight in asks:
                            x, y = edge[t], edge[t + 1]
                            if y - x > n * DENSE:
                                total += weight * whole(t)
                            elif y > x:
                                total[doc[x:y]] += weight * part[x:y]
                        at = np.flatnonzero(total >= cut[q])
                        mine = total[at]
                        total.fill(0.0)
                    else:
                        for t in codes[own][leads[own]].tolist():
                            mark[doc[edge[t] : edge[t + 1]]] = True
                        at = np.flatnonzero(mark)
                        mark[at] = False
                        beside = []
                        for t, weight in asks:  # in the same order as above, so that sums are the same
                            x, y = edge[t], edge[t + 1]
                            if y - x > n * KEPT:
                                total[at] += weight * whole(t)[at]
                            elif y > x:
                                total[doc[x:y]] += weight * part[x:y]
                                beside.append(doc[x:y])
                        mine = total[at]
                        total[at] = 0.0
                        for x in beside:
                            total[x] = 0.0
                        in_reach = mine >= cut[q]
                        at, mine = at[in_reach], mine[in_reach]
                    if len(at) > k:
                        best = mine >= np.partition(mine, len(at) - k)[len(at) - k] - slack
                        at, mine = at[best], mine[best]
                    if len(at):
                        qs.append(np.full(len(at), q - a))
                        rows.append(at)
                        scores.append(np.round(mine, PLACES))
                if not qs:
                    continue
                fresh[i].append((np.concatenate(qs), np.concatenate(scores), batch.column(0).take(pa.array(np.concatenate(rows)))))
                if sum(len(x[0]) for x in fresh[i]) >= LISTS_AT_ONCE * k // 4:
                    merge(i)
        for i in range(len(starts)):
            if fresh[i]:
                merge(i)
        for a, (q, score), ids in zip(starts, held, held_ids):
            if ids is not None:
                yield pa.RecordBatch.from_arrays([pa.array(numbers[q + a]), ids, pa.array(score)], names=["list_no", "id", "score"])
        pa.default_memory_pool().release_unused()  # the process stays for other tasks

    return post.select("id", "terms").mapInArrow(run, f"list_no int, id {post.schema['id'].dataType.simpleString()}, score double")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, the first ones smaller."""
    sizes = list(FIRST_SLICES)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            size = sizes.pop(0) if sizes else SLICE
            yield batch.slice(at, size)
            at += size
