"""Filling containers of a fixed token capacity, balancing their estimated training cost."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.llm.tokens import TOKENIZER, sized
from clauseworks.operators.materialize import written

#: Containers' worth of tokens that one task packs: bounds a task and costs at most about one container in so many.
CONTAINERS_PER_SHARD = 512


def fill(sizes: np.ndarray, capacity: int, quadratic: float) -> np.ndarray:
    """Container of each item, items in descending size.

    The cost of an item is its length plus `quadratic` x length² / capacity (attention within the item). Each item goes
    to the container of least cost so far among those with room; where none has room, a new one is opened.
    """
    opened = max(1, math.ceil(int(sizes.sum()) / capacity))
    room, cost = np.full(opened, capacity, np.int64), np.zeros(opened)
    place = np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        open_cost = np.where(room >= size, cost, np.inf)
        k = int(open_cost.argmin())
        if open_cost[k] == np.inf:
            k = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[k] -= size
        cost[k] += size + quadratic * size * size / capacity
        place[i] = k
    return place


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 8192, quadratic: float = 1.0, tokenizer: str = TOKENIZER, containers_per_shard: int = CONTAINERS_PER_SHARD) -> DataFrame:
    """(id, part, n_parts, token_from, n_tokens, shard, container): every text in a container of at most `capacity` tokens.

    Texts are measured once in tokens and only sizes travel. A text above the capacity is divided into full parts and
    a rest; no other is divided. Parts are spread by hash over shards of equal token mass, so a task packs a bounded
    number of containers whatever the table's size, and each shard is packed in descending size onto the sequence of
    lowest cost. Null and empty texts have no tokens and take no container; an id delivered again counts once.
    """
    sizes = written(sized(df, id_col, text_col, path=tokenizer).where(F.col("n_tokens") > 0))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, math.ceil(total / (capacity * containers_per_shard)))
    n_parts = F.ceil(F.col("n_tokens") / capacity).cast("int")
    parts = sizes.select(F.col(id_col).alias("_id"), F.col("n_tokens").alias("_all"), n_parts.alias("n_parts"))
    parts = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    start = F.col("part").cast("long") * capacity
    parts = parts.select("_id", "part", "n_parts", start.alias("token_from"), F.least(F.lit(capacity).cast("long"), F.col("_all") - start).alias("n_tokens"))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("_id", "part"), F.lit(shards)).cast("int"))

    def pack_shard(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_tokens", "_id", "part"], ascending=[False, True, True], kind="stable")
        shard["container"] = fill(shard["n_tokens"].to_numpy(), capacity, quadratic)
        return shard

    packed = parts.groupBy("shard").applyInPandas(pack_shard, parts.schema.simpleString()[7:-1] + ",container:bigint")
    return packed.select(F.col("_id").alias(id_col), "part", "n_parts", "token_from", "n_tokens", "shard", "container")


def divided(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the texts that a packing divided, that is, that alone exceed a container."""
    return packed.where(F.col("n_parts") > 1).select(id_col).distinct()


def fill_rates(packed: DataFrame, capacity: int = 8192) -> DataFrame:
    """(shard, containers, n_tokens, fill_rate, heaviest_share) of a packing."""
    each = packed.groupBy("shard", "container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("items"))
    rate = F.sum("t") / (F.count("*") * F.lit(capacity))
    return each.groupBy("shard").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("t").alias("n_tokens"), rate.alias("fill_rate"), F.max("t").alias("fullest"))
