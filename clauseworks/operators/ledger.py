"""Idempotent ingestion: what is indexed already, what changed, what to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.operators.index import upsert

KEY = ["index_name", "namespace", "document"]
COMPARED = ["chunk_fingerprint", "chunk_count", "embedder", "model", "dimension"]


def pending(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """`current` with `state`: "skip" where the ledger has the same document with all five fields equal, "replace" where it differs, "new" where it isn't there."""
    old = ledger.select(*KEY, *[F.col(c).alias(f"_{c}") for c in COMPARED], F.lit(True).alias("_known"))
    equal = F.lit(True)
    for c in COMPARED:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    state = F.when(F.col("_known").isNull(), "new").when(equal, "skip").otherwise("replace")
    return current.join(old, KEY, "left").withColumn("state", state).select(*current.columns, "state")


def mark(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger with the documents that are stored now; written last, so a failure before leaves them pending."""
    rows = done.select(*KEY, *COMPARED, F.current_timestamp().alias("indexed_at"))
    return upsert(ledger.select(rows.columns), rows, KEY)


def clear_index(ledger: DataFrame, index_name: str) -> tuple[DataFrame, int]:
    """The ledger without an index's records, and how many there were."""
    mine = F.col("index_name") == index_name
    return ledger.where(~mine), ledger.where(mine).count()


def sync_states(files: DataFrame, tracked: DataFrame, name: str = "source_file", digest: str = "sha256") -> DataFrame:
    """(name, state): "new", "changed" or "unchanged" of the files there are, "missing" of tracked ones that are gone."""
    now = files.select(name, F.col(digest).alias("_now"), F.lit(True).alias("_here"))
    then = tracked.select(name, F.col(digest).alias("_then"), F.lit(True).alias("_there"))
    state = F.when(F.col("_here").isNull(), "missing").when(F.col("_there").isNull(), "new").when(F.col("_now").eqNullSafe(F.col("_then")), "unchanged").otherwise("changed")
    return now.join(then, name, "full_outer").select(name, state.alias("state"))


def file_digests(binary_files: DataFrame) -> DataFrame:
    """(source_file, sha256, file_size) of a binaryFile scan."""
    return binary_files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_size"))


def ingest(current: DataFrame, chunks: DataFrame, vectors: DataFrame | None, keyword: DataFrame, ledger: DataFrame, embed, new_index: bool = False) -> dict[str, DataFrame]:
    """One idempotent run over documents (`current`: ledger key and compared fields) and their chunks (document, id, text, ...).

    A new index clears its records; documents the ledger knows unchanged are skipped; the others' vectors are embedded and
    replace the ones they had; keyword rows likewise, those of the same index and namespace only. `plans.runner.ingest`
    writes the results in order.
    """
    if new_index:
        names = current.select("index_name").distinct()
        ledger, vectors = ledger.join(names, "index_name", "left_anti"), None
    todo = pending(current, ledger).where(F.col("state") != "skip").drop("state")
    fresh = chunks.join(todo.select("document", "namespace", "index_name"), "document")
    made = embed(fresh)
    kept = None if vectors is None else vectors.join(todo.select(*KEY), KEY, "left_anti")
    stored = made if kept is None else kept.unionByName(made.select(kept.columns))
    same = [c for c in KEY if c in keyword.columns]
    words = keyword.join(todo.select(*same), same, "left_anti").unionByName(fresh.select(keyword.columns))
    return {"vectors": stored, "keyword": words, "ledger": mark(ledger, todo), "todo": todo}
