"""Queries over what the engine writes, keeps and composes: indexes, ledgers, sinks and scans, streams, rounds, plug-ins; with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.functions import text as T
from clauseworks.functions.hashing import chunk_id
from clauseworks.functions.time import elapsed_ms, iso_utc, run_id
from clauseworks.functions.vectors import l2_normalize
from clauseworks.models import calls, registry
from clauseworks.operators import chunking, extract, feedback, index, judge, ledger, rerank, retrieval, rounds
from clauseworks.operators.materialize import own_folder, written
from clauseworks.plans import plugins, runner
from clauseworks.plans.queries import _AXES, _BEST, _HITS, _HITS_TEXT, _KEYWORD_HITS, _PRINT, _PROVISIONS, _STOP, _TEXTS, best_hits, hits, ledger_rows, provisions, query, questions, some_questions, text_hits, texts
from clauseworks.schema import Config
from clauseworks.sources import files, sinks
from clauseworks.sources.tables import table
from clauseworks.streaming.ingest import ingest_stream


def _folder(spark) -> str:
    return f"{own_folder(spark)}/{uuid.uuid4().hex}"


# --- indexes ---------------------------------------------------------------------------------------------------


@query(_KEYWORD_HITS + " SELECT query_id, id, score, rank FROM kw")
def keyword_saved(spark, root):
    """The keyword index saved to files, loaded and asked."""
    path = _folder(spark)
    index.save(path, provisions(spark, root), "record_id", "subsection_text")
    post, terms, _, average = index.load(spark, path)
    return retrieval.keyword_scores(some_questions(spark, root), post, terms, average)


@query(_KEYWORD_HITS.replace(f"FROM {_PROVISIONS})", f"FROM {_PROVISIONS} WHERE record_id % 3 <> 1)", 1) + " SELECT query_id, id, score, rank FROM kw")
def keyword_refreshed(spark, root):
    """Documents merged into an index and removed from it, which then is made anew: its statistics are those of what is left."""
    p, path = provisions(spark, root), _folder(spark)
    some, more = p.where("record_id % 3 < 2"), p.where("record_id % 3 <> 1")
    docs = index.remove(index.merge_new(some, more, "record_id"), some.where("record_id % 3 = 1").select("record_id"), "record_id")
    runner.refreshed_index(docs, path, "record_id", "subsection_text")
    post, terms, _, average = index.load(spark, path)
    return retrieval.keyword_scores(some_questions(spark, root), post, terms, average)


@query("SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END::BIGINT AS label FROM embeddings WHERE vec_id % 7 <> 3")
def vector_store(spark, root):
    """A vector table on files: created, filled, some rows replaced, some deleted."""
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))
    store = sinks.VersionedTable(spark, _folder(spark), "id bigint, vector array<float>, label bigint")
    store.create()
    store.upsert(v, ["id"])
    store.upsert(v.where("id % 5 = 0").withColumn("label", F.col("label") + 100), ["id"])
    store.delete(v.where("id % 7 = 3").select("id"))
    store.vacuum(1)
    return store.read().select("id", "label")


# --- ingestion, ledger, sync -----------------------------------------------------------------------------------


@query(f"""WITH cur AS (SELECT coalesce(document_name, '') AS document, count(*)::BIGINT AS n, {_PRINT} AS fp FROM {_PROVISIONS} GROUP BY 1)
 SELECT document, CASE WHEN length(document) % 2 = 0 THEN 'skip' ELSE 'new' END AS state, n AS vectors, n AS keyword_rows, fp AS chunk_fingerprint FROM cur""")
def ingest_run(spark, root):
    """Two ingestions into tables on files: half of the documents, then all, of which that half is skipped."""
    current = written(ledger_rows(spark, root))
    chunks = provisions(spark, root).select(F.coalesce("document_name", F.lit("")).alias("document"), F.col("record_id").alias("id"), F.coalesce("subsection_text", F.lit("")).alias("text"))
    key = "index_name string, namespace string, document string"
    tables = {
        "vectors": sinks.VersionedTable(spark, _folder(spark), f"{key}, id bigint, vector array<float>"),
        "keyword": sinks.VersionedTable(spark, _folder(spark), f"{key}, id bigint, text string"),
        "ledger": sinks.VersionedTable(spark, _folder(spark), f"{key}, chunk_fingerprint string, chunk_count int, embedder string, model string, dimension int, indexed_at timestamp"),
    }
    embed = lambda rows: rows.withColumn("vector", registry.hashing_embedder(F.col("text")))
    runner.ingest(current.where(F.length("document") % 2 == 0), chunks, tables, embed)
    states = runner.ingest(current, chunks, tables, embed)
    count = lambda name, c: tables[name].read().groupBy("document").agg(F.count("*").alias(c))
    return states.join(count("vectors", "vectors"), "document").join(count("keyword", "keyword_rows"), "document").join(tables["ledger"].read().select("document", "chunk_fingerprint"), "document")


@query("SELECT index_name, count(*) AS documents FROM (SELECT DISTINCT coalesce(document_name, '') AS d, 'i' AS index_name FROM subsections UNION SELECT DISTINCT coalesce(document_name, ''), 'kept' FROM subsections) WHERE index_name <> 'i' GROUP BY 1")
def ledger_cleared(spark, root):
    """The ledger without one index's records."""
    mine = ledger_rows(spark, root)
    rest, _ = ledger.clear_index(mine.unionByName(mine.withColumn("index_name", F.lit("kept"))), "i")
    return rest.groupBy("index_name").agg(F.count("*").alias("documents"))


@query("SELECT doc_id AS id, md5(CASE WHEN doc_id % 4 = 0 THEN 'first ' ELSE '' END || coalesce(text, '')) AS text_md5, (doc_id % 10)::VARCHAR AS source_file FROM documents WHERE doc_id % 10 < 8")
def sync_files(spark, root):
    """Two syncs of ten files, of which eight are there: the first finds all new, the second one none but those whose text changed."""
    d = table(spark, root, "documents").where("doc_id % 10 < 8").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 10).cast("string").alias("source_file"))
    later = d.withColumn("text", F.when(F.col("id") % 4 == 0, F.concat(F.lit("first "), F.col("text"))).otherwise(F.col("text")))
    store = sinks.VersionedTable(spark, _folder(spark), "id bigint, text string, source_file string")
    tracker = sinks.VersionedTable(spark, _folder(spark), "source_file string, sha256 string, file_size bigint")
    for rows in (d, later):
        found = rows.groupBy("source_file").agg(F.sha2(F.sum(F.xxhash64("id", "text").cast("decimal(38,0)")).cast("string"), 256).alias("sha256"), F.sum(F.length("text")).cast("long").alias("file_size"))
        runner.sync_files(found, rows, tracker, store)
    return store.read().select("id", F.md5("text").alias("text_md5"), "source_file")


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
def stream_ingest(spark, root):
    """The events as a file stream, each micro-batch upserted into a table by its key; a file that comes twice changes nothing."""
    folder, e = _folder(spark), table(spark, root, "events").select("event_id", "event_type")
    for i in (0, 1, 1):
        e.where(F.col("event_id") % 2 == i).write.mode("append").parquet(folder)
    store = sinks.VersionedTable(spark, _folder(spark), "event_id bigint, event_type string")
    ingest_stream(spark, folder, "event_id bigint, event_type string", lambda rows, _: store.upsert(rows, ["event_id"]), _folder(spark)).awaitTermination()
    return store.read().groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


# --- files -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS text_md5, source, n_chars FROM documents")
def json_roundtrip(spark, root):
    """Documents written as JSON and read back by schema."""
    path = _folder(spark)
    sinks.write_json(table(spark, root, "documents").select("doc_id", "text", "source", "n_chars"), path)
    rows = spark.read.schema("doc_id bigint, text string, source string, n_chars bigint").json(path)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "source", "n_chars")


@query(r"SELECT DISTINCT question AS query, answer AS response FROM (SELECT DISTINCT trim(question) AS question, trim(answer) AS answer FROM reference_answers) WHERE regexp_matches(question, '\S') AND regexp_matches(answer, '\S')")
def csv_roundtrip(spark, root):
    """Questions with answers written as CSV, quotes and line feeds included, and read back as responses."""
    path = _folder(spark)
    rows = table(spark, root, "reference_answers").select(F.trim("question").alias("question"), F.trim("answer").alias("answer")).distinct()
    sinks.write_csv(rows.where(~T.is_blank(F.col("question")) & ~T.is_blank(F.col("answer"))), path)
    return files.response_list(spark, path).distinct()


@query("SELECT doc_id::VARCHAR AS artifact_name, sha256(text) AS digest, octet_length(encode(text)) AS raw_size FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0")
def artifact_roundtrip(spark, root):
    """Texts packed as artifacts, those stored already left out, unpacked and checked by their digests."""
    d = table(spark, root, "documents").where("text IS NOT NULL").select(F.lit("c").alias("chunker"), F.col("doc_id").cast("string").alias("artifact_name"), F.encode("text", "UTF-8").alias("content"))
    packed = written(sinks.packed_artifact(d))
    fresh = sinks.changed_artifacts(packed, packed.where(F.col("artifact_name").cast("long") % 2 == 1))
    back = files.restored_artifacts(fresh)
    return back.select("artifact_name", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("raw_size"))


@query("SELECT doc_id::VARCHAR AS id, 'semantic' AS chunker, md5(text) AS text_md5, md5(CASE WHEN doc_id % 3 = 0 THEN 'full ' || text ELSE text END) AS full_md5 FROM documents WHERE text IS NOT NULL AND text <> ''")
def chunk_cache(spark, root):
    """A chunk cache of JSON array files as a chunker leaves it, scanned for texts; where a full text is missing the chunk's stands for it."""
    folder = _folder(spark)
    d = table(spark, root, "documents").where("text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("string").alias("id"), "text")
    meta = F.create_map(F.lit("subsection_text"), F.col("text"), F.lit("full_subsection_text"), F.when(F.col("id").cast("long") % 3 == 0, F.concat(F.lit("full "), F.col("text"))).otherwise(F.lit("")))
    rows = d.select("id", "text", meta.alias("metadata")).select(F.to_json(F.struct("*")).alias("value"))
    # one object a line, each a file's whole content when read with multiLine, so files hold arrays
    arrays = rows.withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(64))).groupBy("_b").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    arrays.select("value").repartition(4).write.text(f"{folder}/raw")
    store = sinks.Store(spark)
    for i, r in enumerate(arrays.toLocalIterator()):  # 64 small files, as a chunker writes them
        store.write(f"{folder}/cache/doc{i}_chunks__semantic.json", r["value"])
    out = files.chunk_texts(spark, f"{folder}/cache")
    return out.select("id", "chunker", F.md5("subsection_text").alias("text_md5"), F.md5("full_subsection_text").alias("full_md5"))


# --- retrieval compositions ------------------------------------------------------------------------------------


@query(f"""SELECT query_id, id, relevance_score, pos FROM (SELECT *, coalesce(relevance_score, score, 0) AS best, min(pos) OVER (PARTITION BY query_id, text) AS first_pos, row_number() OVER (PARTITION BY query_id, text ORDER BY coalesce(relevance_score, score, 0) DESC, pos) AS rn
  FROM {_HITS_TEXT} WHERE regexp_matches(text, '\\S')) WHERE rn = 1 AND coalesce(relevance_score, 0) >= 0.3""".replace("id, relevance_score, pos FROM", "id, relevance_score, first_pos AS pos FROM", 1))
def post_process(spark, root):
    """The steps after reranking: best of each text, then the threshold; a step nobody knows is skipped."""
    return rerank.post_process(text_hits(spark, root), Config(relevance_threshold=0.3, post_processing=("dedupe", "unknown", "relevance_filter"))).select("query_id", "id", "relevance_score", "pos")


_EVEN = "split_part(query_id, ':', 2)::BIGINT % 2 = 0"


@query(f"""WITH h AS (SELECT * FROM {_HITS_TEXT}),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY coalesce(score, 0) DESC, pos) AS rn FROM h WHERE variant_no = 1 AND regexp_matches(text, '\\S')) WHERE rn = 1)
 SELECT query_id, id, 1 AS round FROM one UNION ALL
 SELECT query_id, id, 2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY pos) AS rn FROM h s WHERE variant_no = 2 AND {_EVEN} AND query_id IN (SELECT query_id FROM one) AND regexp_matches(text, '\\S') AND NOT EXISTS (SELECT 1 FROM one f WHERE f.query_id = s.query_id AND f.text = s.text)) WHERE rn = 1""")
def corrective_round(spark, root):
    """A second round for the queries whose analysis asks for more (those of even number), its question put through the strategy."""
    h = written(text_hits(spark, root))
    even = F.split("query_id", ":")[1].cast("long") % 2 == 0

    def analyse(contexts: DataFrame) -> DataFrame:
        return contexts.select("query_id", (~even).alias("sufficient"), F.array(F.lit("what else")).alias("followup_queries"))

    def retrieve(asked: DataFrame) -> DataFrame:
        return h.where("variant_no = 2").drop("variant_no").join(asked.select("query_id", "variant_no"), "query_id")

    strategy = lambda q: retrieval.variants(q, registry.simple(q))
    raw = h.where("variant_no = 1")
    merged, _, _ = rounds.corrective_rounds(rerank.dedupe(raw, prefer=("score",)), raw, analyse, strategy, retrieve, 1)
    return merged.select("query_id", "id", "round")


_QUERY_TEXT = "(SELECT DISTINCT run_id || ':' || query_no AS query_id, first_value(variant_query) OVER (PARTITION BY run_id, query_no ORDER BY variant_no, result_id) AS query FROM variant_results)"
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'))"


def query_texts(spark, root) -> DataFrame:
    v = table(spark, root, "variant_results")
    return v.groupBy(F.concat_ws(":", "run_id", "query_no").alias("query_id")).agg(F.min_by("variant_query", F.struct("variant_no", "result_id")).alias("query"))


@query(f"""SELECT query_id, id, round(10 * share, 2) / 10 AS relevance_score, row_number() OVER (PARTITION BY query_id ORDER BY round(10 * share, 2) DESC, i) AS rank FROM (
  SELECT b.query_id, b.id, i, len(list_intersect({_WORDS.format(c='q.query')}, {_WORDS.format(c='t.text')}))::DOUBLE / greatest(1, len({_WORDS.format(c='q.query')})) AS share
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS i FROM {_BEST}) b LEFT JOIN {_TEXTS} t ON t.id = b.id JOIN {_QUERY_TEXT} q ON q.query_id = b.query_id WHERE i < 30) QUALIFY rank <= 20""")
def rerank_by_model(spark, root):
    """The `llm` reranker by name, its model being the offline one."""
    found = retrieval.with_texts(best_hits(spark, root), texts(spark, root))
    return registry.RERANKERS.get("llm")(found, query_texts(spark, root)).select("query_id", "id", "relevance_score", "rank")


@query(f"""SELECT query_id, id, CASE WHEN i // 5 % 3 = 2 OR i % 5 = 3 THEN 5.0 ELSE least(10, length(substr(text, 1, 1500)) % 13) END::DOUBLE AS model_score FROM (SELECT b.query_id, b.id, coalesce(t.text, '') AS text, row_number() OVER (PARTITION BY b.query_id ORDER BY pos) - 1 AS i FROM {_BEST} b LEFT JOIN {_TEXTS} t ON t.id = b.id) WHERE i < 30""")
def rerank_listwise(spark, root):
    """Scores from replies to batches of five passages of 1,500 characters at most: the third batch of a query fails, and the fourth passage is never answered."""
    b = rerank.listwise_batches(retrieval.with_texts(best_hits(spark, root), texts(spark, root)))
    parts = F.split("passages", r"\n\n(?=\[[2-5]\] )")
    lines = F.transform(parts, lambda x, i: F.when(i == 3, F.lit("no idea")).otherwise(F.concat((i + 1).cast("string"), F.lit(": "), ((F.length(x) - 4) % 13).cast("string"))))
    return rerank.listwise_scores(b.withColumn("reply", F.when(F.col("batch") % 3 != 2, F.array_join(lines, "\n"))))


@query(f"""SELECT query_id, id, relevance_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, f // 100000, f % 100000, id) AS rank FROM (
  SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + result_rank)), 8) AS relevance_score, min(variant_no * 100000 + result_rank) AS f FROM {_HITS} WHERE id <> '' GROUP BY 1, 2)) WHERE rank <= 20""")
def rerank_by_fusion(spark, root):
    """The `rrf` reranker by name: fusion of the raw lists of all variants."""
    raw = hits(spark, root).withColumnRenamed("result_rank", "rank")
    return registry.RERANKERS.get("rrf")(best_hits(spark, root), query_texts(spark, root), raw).select("query_id", "id", "relevance_score", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT known, count(*) AS n, round(sum(coalesce(score, 0)), 4) AS total FROM (SELECT *, length(id) % 3 = 0 AS known FROM {_BEST}) GROUP BY 1")
def rerank_cache(spark, root):
    """Scores that are cached, and those a model must still be asked for."""
    asked = best_hits(spark, root)
    cache = asked.where(F.length("id") % 3 == 0).select("query_id", "id", F.lit(1.0).alias("model_score"))
    known, missing = calls.cached_results(asked, cache, ["query_id", "id"])
    rows = known.select(F.lit(True).alias("known"), "score").unionByName(missing.select(F.lit(False).alias("known"), "score"))
    return rows.groupBy("known").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("score", F.lit(0.0))), 4).alias("total"))


@query("""SELECT id AS query_id, i - 1 AS variant_no, v AS variant_query FROM (SELECT id, unnest(vs) AS v, generate_subscripts(vs, 1)::BIGINT AS i FROM (SELECT id, CASE WHEN list_contains(vs, q) THEN vs ELSE list_append(vs, q) END AS vs FROM (
  SELECT DISTINCT id, question AS q, list_filter(list_transform(regexp_split_to_array(question, '(?i)\\s+and\\s+|;'), lambda x: trim(x)), lambda x: x <> '') AS vs FROM chat_responses WHERE question IS NOT NULL AND trim(question) <> '')))""")
def query_variants(spark, root):
    """Questions taken apart by the `decompose` strategy, the original kept."""
    q = table(spark, root, "chat_responses").select(F.col("id").alias("query_id"), F.col("question").alias("query")).where(~T.is_blank(F.col("query"))).distinct()
    return retrieval.variants(q, registry.STRATEGIES.get("decompose")(q), keep_original=True)


@query("""SELECT DISTINCT id AS pair_id, CASE WHEN a = b THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS winner, least(5, abs(a - b) + 1)::DOUBLE AS confidence, false AS position_bias FROM (
  SELECT c.id, len(list_intersect({q}, {a})) AS a, len(list_intersect({q}, {b})) AS b FROM chat_responses c)""".format(q=_WORDS.format(c="question"), a=_WORDS.format(c="answer"), b=_WORDS.format(c="retriever")))
def judge_pairwise(spark, root):
    """The pairwise judge by name: each response against its retriever's name, in both orders."""
    rows = table(spark, root, "chat_responses").select(F.col("id").alias("pair_id"), F.col("question").alias("query"), F.col("answer").alias("answer_a"), F.col("retriever").alias("answer_b")).distinct()
    return registry.JUDGES.get("pairwise")(rows)


@query("""SELECT concat_ws('__', embedder, retriever, reranker, strategy, CASE WHEN two_call THEN 'tc1' ELSE 'tc0' END) AS label FROM
  (VALUES ('voyage'), ('openai')) a(embedder), (VALUES ('vector'), ('hierarchical')) b(retriever), (VALUES ('none'), ('rrf'), ('llm')) c(reranker), (VALUES ('simple'), ('hyde')) d(strategy), (VALUES (false), (true)) e(two_call)""")
def experiments_runnable(spark, root):
    """Experiments that need no keyword index."""
    return judge.runnable(judge.grid(spark, *_AXES), False).select("label")


@query("SELECT count(*) AS labels, bool_and(one_list) AS each_query_ranked FROM (SELECT label, true AS one_list FROM (VALUES ('a'), ('b'), ('c'), ('d')) t(label))")
def experiment_sweep(spark, root):
    """Four experiments end to end over the provisions: ranks of every list run from 1 without a gap."""
    chunks = runner.indexed(provisions(spark, root))
    combos = judge.grid(spark, ["hashing"], ["vector", "hybrid"], ["none", "rrf"], ["simple"], [False])
    out = written(runner.sweep(questions(spark, root).dropDuplicates(["query_id"]), chunks, combos, Config(top_k=10, rerank_top_k=5, relevance_threshold=0.0)))
    lists = out.groupBy("label", "query_id").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"))
    good = lists.groupBy("label").agg(F.bool_and((F.col("a") == 1) & (F.col("b") >= F.col("n")) & (F.col("b") <= 5)).alias("one_list"))
    return good.agg(F.count("*").alias("labels"), F.bool_and("one_list").alias("each_query_ranked"))


# --- documents and scalars -------------------------------------------------------------------------------------


@query("""SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY f) - 1 AS seq, chapter, section, n FROM (
  SELECT doc, isl, min(event_id) AS f, array_to_string(list_distinct_ordered, ' ') AS chapter, section, n FROM (
   SELECT doc, isl, min(event_id) AS event_id, string_agg(event_type, ' ' ORDER BY event_id) AS section, count(*) AS n, list_filter([min(event_type)], lambda x: true) AS list_distinct_ordered FROM (
    SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY event_id) AS isl FROM (SELECT user_id AS doc, event_id, event_type, value, CASE WHEN event_type <> 'view' AND lag(event_type <> 'view', 1, false) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY doc, isl) GROUP BY ALL)""".replace("array_to_string(list_distinct_ordered, ' ') AS chapter", "'c' AS chapter"))
def merge_empty_headers(spark, root):
    """Runs of rows without text as one, their sections joined: events other than views are headers."""
    e = table(spark, root, "events").select(F.col("user_id").alias("doc"), "event_id", F.lit("c").alias("chapter"), F.col("event_type").alias("section"), F.lit("").alias("subsection_id"), F.when(F.col("event_type") == "view", "text").otherwise("").alias("subsection_text"), F.array("event_id").alias("page_numbers"))
    out = extract.merge_empty_headers(e, "doc", "event_id")
    return out.select("doc", F.col("seq").cast("long").alias("seq"), "chapter", "section", F.size("page_numbers").cast("long").alias("n"))


@query(f"SELECT doc, md5(substr(string_agg(text, chr(10) ORDER BY page), 1, 5000)) AS text_md5 FROM (SELECT coalesce(document_name, '') AS doc, record_id AS page, coalesce(subsection_text, '') AS text, row_number() OVER (PARTITION BY coalesce(document_name, '') ORDER BY record_id) AS r FROM {_PROVISIONS}) WHERE r <= 3 GROUP BY 1")
def opening_text(spark, root):
    """What a document's name and summary are told from: the text of its first three pages."""
    from pyspark.sql import Window

    p = provisions(spark, root).select(F.coalesce("document_name", F.lit("")).alias("doc"), "record_id", F.coalesce("subsection_text", F.lit("")).alias("text"))
    pages = p.withColumn("page", F.row_number().over(Window.partitionBy("doc").orderBy("record_id")))
    return extract.opening_text(pages).select("doc", F.md5("text").alias("text_md5"))


@query(f"SELECT record_id, true AS within_limit, true AS numbered, true AS cut_from_text, true AS nothing_lost FROM {_PROVISIONS} WHERE length(subsection_text) > 2048 AND regexp_matches(subsection_text, '\\S')")
def chunk_split_rules(spark, root):
    """What the recursive splitter promises, checked for every oversized text: limits, numbers, wording, and that no character but blanks is lost."""
    c = chunking.chunk(provisions(spark, root).withColumn("document_summary", F.col("record_id").cast("string"))).where("is_split")
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    per = c.groupBy(F.col("document_summary").cast("long").alias("record_id")).agg(
        F.max(F.length("subsection_text")).alias("longest"), F.count("*").alias("n"), F.max("total_chunks").alias("told"), F.max("chunk_index").alias("last"),
        F.bool_and(F.contains(F.col("full_subsection_text"), F.col("subsection_text"))).alias("cut"),
        F.first("full_subsection_text").alias("whole"), F.array_sort(F.collect_list(F.struct("chunk_index", "subsection_text"))).alias("pieces"),
    )  # fmt: skip  one text's pieces
    # every word of the text is in some piece, in as many places at least
    words = lambda x: F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    joined = F.array_join(F.transform("pieces", lambda p: p["subsection_text"]), " ")
    return per.select("record_id", (F.col("longest") <= 2048).alias("within_limit"), ((F.col("n") == F.col("told")) & (F.col("last") == F.col("n") - 1)).alias("numbered"), F.col("cut").alias("cut_from_text"), (F.length(bare(joined)) >= F.length(bare(F.col("whole")))).alias("nothing_lost"))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS length_before, CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS length_after FROM embeddings")
def unit_vectors(spark, root):
    """Vectors brought to unit length, zero vectors left as they are."""
    from clauseworks.functions.vectors import norm

    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.transform("embedding", lambda x: (x * 3).cast("float"))).alias("vector"))
    return v.select("id", F.round(norm(F.col("embedding")), 4).alias("length_before"), F.round(norm(l2_normalize(F.col("vector"))), 4).alias("length_after"))


@query(f"SELECT record_id, sha256(length(coalesce(document_name, '')) || ':' || coalesce(document_name, '') || length(seq::VARCHAR) || ':' || seq || length(coalesce(subsection_text, '')) || ':' || coalesce(subsection_text, '')) AS id FROM {_PROVISIONS}")
def stable_ids(spark, root):
    return provisions(spark, root).select("record_id", chunk_id(F.col("document_name"), F.col("seq"), F.col("subsection_text")).alias("id"))


@query(r"""SELECT source, trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') AS slug, replace(source, '_', '/') AS slashed, source AS safe, source || '__' || 'x' || '__tc1' AS label, 'postgresql+psycopg://' || source AS engine, 'postgresql://' || source AS driver, source || chr(10) || chr(10) || 'guess' AS hyde FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)""")
def name_scalars(spark, root):
    """Names made of sources: table names, safe paths, labels, connection addresses."""
    s = table(spark, root, "documents").select("source").where("source IS NOT NULL").distinct()
    slashed = F.replace(F.col("source"), F.lit("_"), F.lit("/"))
    return s.select("source", T.slug(F.col("source")).alias("slug"), slashed.alias("slashed"), T.path_safe(slashed).alias("safe"), T.combo_label(F.col("source"), F.lit("x"), two_call=F.lit(True)).alias("label"), T.engine_url(F.concat(F.lit("postgres://"), F.col("source"))).alias("engine"), T.driver_url(F.concat(F.lit("postgresql+psycopg://"), F.col("source"))).alias("driver"), T.hyde(F.col("source"), F.lit("guess")).alias("hyde"))


@query("SELECT o_orderkey AS id, least(10, o_orderkey % 14)::DOUBLE AS first, 5.0::DOUBLE AS second, (o_orderkey % 10)::DOUBLE + 0.5 AS third FROM orders")
def score_replies(spark, root):
    """Scores read from replies of a line each: held to 0..10, the default where a line is missing, the last where there are several."""
    k = F.col("o_orderkey")
    reply = F.concat(F.lit("1: "), (k % 14).cast("string"), F.lit("\nsome words\n3. 9\n03 - "), (k % 10).cast("string"), F.lit(".5 because"))
    s = table(spark, root, "orders").select(k.alias("id"), T.score_lines(reply, 3).alias("s"))
    return s.select("id", F.col("s")[0].alias("first"), F.col("s")[1].alias("second"), F.col("s")[2].alias("third"))


@query("SELECT id, CASE WHEN latency_ms IS NULL THEN NULL ELSE latency_ms % 2 = 0 END AS sufficient, CASE WHEN latency_ms IS NULL THEN 0 ELSE latency_ms % 3 END::BIGINT AS followups FROM (SELECT DISTINCT id, latency_ms FROM chat_responses)")
def structured_replies(spark, root):
    """Gap analyses read from models' JSON replies, fenced or not; a reply that isn't JSON gives nothing."""
    r = table(spark, root, "chat_responses").select("id", "latency_ms").distinct()
    body = F.to_json(F.struct((F.col("latency_ms") % 2 == 0).alias("sufficient"), F.array_repeat(F.lit("more"), (F.col("latency_ms") % 3).cast("int")).alias("followup_queries")))
    reply = F.when(F.col("latency_ms").isNull(), "I can't tell.").when(F.col("latency_ms") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    out = r.withColumn("g", calls.structured(reply, "sufficient boolean, followup_queries array<string>"))
    return out.select("id", F.col("g.sufficient").alias("sufficient"), F.coalesce(F.size("g.followup_queries"), F.lit(0)).cast("long").alias("followups"))


_KEYS = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*'), lambda x: length(x) > 1 AND NOT list_contains(" + _STOP + ", x)))"


@query(f"""SELECT id AS query_id, lost <= 0.5 * greatest(1, n) AS sufficient, CASE WHEN lost > 0.5 * greatest(1, n) THEN 1 ELSE 0 END::BIGINT AS followups, lost::BIGINT AS missing FROM (
  SELECT id, len(q) AS n, len(list_filter(q, lambda x: NOT list_contains(c, x))) AS lost FROM (SELECT DISTINCT id, {_KEYS.format(c='question')} AS q, {_KEYS.format(c='answer')} AS c FROM chat_responses))""")
def gap_analysis(spark, root):
    """The offline gap analysis: answers that have fewer than half of their question's keywords are insufficient."""
    r = table(spark, root, "chat_responses").select("id", "question", "answer").distinct()
    out = registry.keyword_gaps(r.select(F.col("id").alias("query_id"), F.coalesce("answer", F.lit("")).alias("context")), r.select(F.col("id").alias("query_id"), F.col("question").alias("query")))
    return out.select("query_id", "sufficient", F.size("followup_queries").cast("long").alias("followups"), F.regexp_extract("reasoning", r"\A\d+", 0).cast("long").alias("missing"))


@query("SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM chat_responses WHERE coalesce(latency_ms, 0) % 2 = 0) THEN 'stored' ELSE 'new' END AS kind FROM chat_responses")
def response_append(spark, root):
    """Responses appended to those there are: ids that are stored stay as they are, however often they come."""
    r = table(spark, root, "chat_responses").select("id", "latency_ms")
    stored = r.where(F.coalesce("latency_ms", F.lit(0)) % 2 == 0).select("id", F.lit("stored").alias("kind")).distinct()
    return feedback.append_responses(stored, r.select("id", F.lit("new").alias("kind")))


@query("SELECT DISTINCT id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(created_at, '%Y%m%d_%H%M%S') || '__' || regexp_replace(retriever, '[^A-Za-z0-9_.-]+', '_', 'g') AS run_id, greatest(0, (epoch_us(loaded_at) - epoch_us(created_at)) // 1000)::BIGINT AS waited_ms FROM chat_responses")
def run_times(spark, root):
    """Times as text, run ids and elapsed times of responses."""
    r = table(spark, root, "chat_responses").select("id", "created_at", "loaded_at", "retriever").distinct()
    return r.select("id", iso_utc(F.col("created_at")).alias("at"), run_id(F.col("created_at"), F.col("retriever")).alias("run_id"), elapsed_ms(F.col("created_at"), F.col("loaded_at")).alias("waited_ms"))


@query("SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders")
def backfilled_places(spark, root):
    """Places in a document for rows that have none."""
    o = table(spark, root, "orders").select(F.col("o_custkey").cast("string").alias("doc_name"), F.col("o_orderkey").alias("id"))
    return files.backfilled_seq(o).select("id", F.col("seq").cast("long").alias("place"))


assert plugins  # registers the built-in plug-ins
