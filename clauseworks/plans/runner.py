"""Runners: a retrieval run from names, an ingestion that writes in order, a sweep of experiments."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.functions.text import is_blank
from clauseworks.models.registry import EMBEDDERS, RERANKERS, RETRIEVERS, STRATEGIES, offline_gaps
from clauseworks.operators import chunking, index, judge, ledger, retrieval
from clauseworks.operators.materialize import written
from clauseworks.plans.pipeline import Pipeline, counts
from clauseworks.plans.plugins import check_names
from clauseworks.schema import Config
from clauseworks.sources.sinks import VersionedTable

#: Positions that a variant's list takes up: a list is bounded by top_k and its siblings.
LIST_ROOM = 100_000


def pipeline(chunks: DataFrame, embedder: str = "hashing", retriever: str = "vector", reranker: str = "none", strategy: str = "simple", config: Config = Config(), keep_original: bool = False, analyse: Callable | None = offline_gaps, generate: Callable | None = None, digests: bool = False) -> Pipeline:
    """A pipeline of named plug-ins over `chunks` (id, text, vector, doc_name, chapter, section, subsection_id, prev_ids, next_ids).

    Every different text of the variants is a query of its own to the retriever, so all variants of all queries are searched in
    one job and a text that many ask is searched once. With `digests`, hits have a hash of their text instead of it and neither
    names nor the variant's text, which is enough where texts are only held against each other.
    """
    check_names(embedder, retriever, reranker, strategy)
    embed, search, rank = EMBEDDERS.get(embedder), RETRIEVERS.get(retriever), RERANKERS.get(reranker)
    carried = [c for c in ("text", "doc_name", "chapter", "section", "subsection_id", "page_numbers") if c in chunks.columns and not (digests and c != "text")]
    digest = F.when(is_blank(F.col("text")), F.col("text")).otherwise(F.base64(F.unhex(F.md5("text")))).alias("text")

    def variants(queries: DataFrame) -> DataFrame:
        return retrieval.variants(queries, STRATEGIES.get(strategy)(queries), keep_original)

    def retrieve(asked: DataFrame) -> DataFrame:
        keyed = asked.withColumn("_own", F.to_json(F.struct(F.col("query_id").alias("q"), F.col("variant_no").alias("v"))))
        keyed = written(keyed.withColumn("_key", F.min("_own").over(Window.partitionBy("variant_query"))))
        once = written(keyed.where("_own = _key").select(F.col("_key").alias("query_id"), F.col("variant_query").alias("query"), embed(F.col("variant_query")).alias("vector")))
        hits = search(once, chunks, config)
        hits = hits.withColumnRenamed("query_id", "_key")
        absent = [c for c in carried if c not in hits.columns]
        if digests and "text" in hits.columns:
            hits = hits.withColumn("text", digest)
        hits = hits.join(chunks.select("id", *[digest if digests and c == "text" else c for c in absent]), "id", "left") if absent else hits
        hits = hits.join(keyed.select("_key", "query_id", "variant_no", *[] if digests else ["variant_query"]), "_key").drop("_key")
        return hits.withColumn("pos", F.col("variant_no").cast("long") * LIST_ROOM + F.col("rank"))

    def reranked(hits: DataFrame, queries: DataFrame, raw: DataFrame) -> DataFrame:
        return rank(hits, queries, raw, config).withColumn("pos", F.col("rank").cast("long"))

    return Pipeline(variants, retrieve, reranked, analyse, generate, config)


def indexed(subsections: DataFrame, embedder: str = "hashing", config: Config = Config(), order: str = "seq") -> DataFrame:
    """Chunks of subsections with their neighbours and vectors, as a written table.

    Texts are exchanged once, by document, which serves both the repeated chunks, whose ids have the document in them, and
    the neighbours. Columns that repeat another one's text are neither exchanged nor written, but made where they are read.
    """
    c = chunking.chunk(subsections, order, config.chunk_size, config.chunk_overlap)
    columns = [*c.columns, "prev_ids", "next_ids", "embedded", "vector"]
    c = c.drop("text", "bm25_text").repartition(F.coalesce("doc_name", F.lit("")))
    c = index.keep_first(c, ["doc_name", "id"], ["chunk_index"])
    c = chunking.assign_neighbors(c, "doc_name", "id", "seq", "chunk_index", "id", window=config.neighbor_window)
    c = written(c.withColumn("vector", EMBEDDERS.get(embedder)(chunking.embedded_text())))
    again = {"text": F.coalesce("full_subsection_text", "subsection_text"), "bm25_text": F.col("subsection_text"), "embedded": chunking.embedded_text()}
    return c.withColumns(again).select(*columns)


def retrieve(queries: DataFrame, chunks: DataFrame, **names) -> dict[str, DataFrame]:
    """A retrieval run: all stages' frames and `counts` by query."""
    out = pipeline(chunks, **names).run(queries)
    return out | {"counts": counts(out, queries)}


def sweep(queries: DataFrame, chunks: DataFrame, combos: DataFrame, config: Config = Config(), has_keyword_index: bool = True) -> DataFrame:
    """(label, query_id, id, rank, relevance_score): the final lists of every experiment of `combos` (a grid, some dozens of rows).

    Experiments that differ in what follows the first retrieval share it. Texts go with the hits only where a part reads them.
    """
    from dataclasses import replace

    rows = judge.runnable(combos, has_keyword_index).orderBy("label").collect()  # a few parameters each
    parts, found = [], {}
    for c in rows:
        digests = not c.two_call and not getattr(RERANKERS.get(c.reranker), "reads_text", True) and set(config.post_processing) <= {"dedupe", "relevance_filter"}
        shared = (c.embedder, c.retriever, c.strategy, digests)
        out = pipeline(chunks, c.embedder, c.retriever, c.reranker, c.strategy, replace(config, two_call=c.two_call), digests=digests).run(queries, found.get(shared))
        found.setdefault(shared, out["first"])
        parts.append(out["final"].select(F.lit(c.label).alias("label"), "query_id", "id", F.col("rank").cast("long").alias("rank"), F.col("relevance_score").cast("double").alias("relevance_score")))
    return reduce(DataFrame.unionByName, parts)


def ingest(current: DataFrame, chunks: DataFrame, tables: dict[str, VersionedTable], embed: Callable[[DataFrame], DataFrame], new_index: bool = False) -> DataFrame:
    """Brings `tables` (vectors, keyword, ledger) up to the documents of `current`; what was to do: (document, state).

    The ledger is asked first and written last: vectors that replaced ones of a changed document are stored, then keyword
    rows, then the documents are marked. A run that fails before the mark is made again as a whole, which gives the same.
    Only documents to do are embedded.
    """
    known = tables["ledger"].read()
    states = written(ledger.pending(current, known if not new_index else known.limit(0)).select("document", "state"))
    out = ledger.ingest(current, chunks, tables["vectors"].read(), tables["keyword"].read(), known, embed, new_index)
    todo = written(out["todo"])
    tables["vectors"].write(out["vectors"])
    tables["keyword"].write(out["keyword"])
    base = known.join(current.select("index_name").distinct(), "index_name", "left_anti") if new_index else known
    tables["ledger"].write(ledger.mark(base, todo))
    return states


def refreshed_index(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> None:
    """The saved keyword index after documents were added or removed: df, idf and average length are those of what is there now."""
    index.save(path, docs, id_col, text_col)


def sync_files(files: DataFrame, rows: DataFrame, tracker: VersionedTable, store: VersionedTable, key: str = "id") -> DataFrame:
    """Rows of new and changed files replace those of the same source in `store`, then the tracker is marked; (source_file, state) of all files.

    `files`: source_file, sha256, file_size. `rows`: source_file and the store's columns. The tracker is the commit: without
    its mark the same files are replaced again, with the same result.
    """
    states = written(ledger.sync_states(files, tracker.read()))
    todo = states.where(F.col("state").isin("new", "changed")).select("source_file")
    fresh = rows.join(todo, "source_file", "left_semi")
    kept = store.read().join(todo, "source_file", "left_anti")
    store.write(index.upsert(kept, fresh.select(kept.columns), [key], "source_file"))
    done = files.join(todo, "source_file", "left_semi").select(tracker.read().columns)
    tracker.write(index.upsert(tracker.read(), done, ["source_file"]))
    return states
