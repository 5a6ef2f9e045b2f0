"""Hashes: stable chunk ids and order-sensitive fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_id(*parts: Column) -> Column:
    """A stable id from the parts, each with its length before it, so that neighbouring parts can't run together."""
    each = [F.concat(F.length(F.coalesce(p.cast("string"), F.lit(""))), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.sha2(F.concat(*each), 256)


def fingerprints(chunks: DataFrame, key: str, position: str, *columns: str) -> DataFrame:
    """(key, chunk_count, chunk_fingerprint): changes with any chunk's content or place.

    Chunks are hashed where they are; only (position, hash) pairs are gathered per document, 72 bytes a chunk.
    """
    each = chunks.select(F.col(key), F.col(position).alias("_p"), F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256).alias("_h"))
    ordered = F.array_sort(F.collect_list(F.struct("_p", "_h")))
    return each.groupBy(key).agg(F.count("*").cast("int").alias("chunk_count"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["_h"]), "\n"), 256).alias("chunk_fingerprint"))
