"""Extraction, chunking, ledger, files, judging, feedback, calls."""

import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from clauseworks.functions import text as T
from clauseworks.functions.hashing import fingerprints
from clauseworks.models import calls
from clauseworks.models.registry import EMBEDDERS, Registry, hashing_embedder
from clauseworks.operators import chunking, extract, feedback, judge, ledger
from clauseworks.plans import pipeline
from clauseworks.sources import files, sinks


def test_fold(spark):
    items = [("d", 1, 0, "continuation", "lead in", None), ("d", 1, 1, "chapter_header", "Chapter I", None), ("d", 1, 2, "section_header", "One", None), ("d", 1, 3, "new_subsection", "text a", "1.1"), ("d", 2, 0, "continuation", "goes on", None), ("d", 2, 1, "new_subsection", "again", "1.1"), ("d", 3, 0, "chapter_header", "Chapter II", None), ("d", 3, 1, "new_subsection", "tail", ""), ("e", 1, 0, "new_subsection", " ", "9"), ("e", 1, 1, "new_subsection", "other", "9")]
    rows = extract.fold_items(spark.createDataFrame(items, "doc string, page int, item int, type string, content string, id string")).orderBy("doc", "seq").collect()
    assert [(r.doc, r.seq, r.chapter, r.section, r.subsection_id, r.subsection_text, r.page_numbers) for r in rows] == [
        ("d", 0, "Preamble", "General", "Introduction/Continuation", "lead in", [1]),
        ("d", 1, "Chapter I", "One", "1.1", "text a goes on again", [1, 2]),
        ("d", 2, "Chapter II", "General", "N/A", "tail", [3]),
        ("e", 0, "Preamble", "General", "9", "other", [1]),
    ]


def test_empty_headers_merge(spark):
    rows = spark.createDataFrame([("d", 1, "A", "x", "1", "", [1]), ("d", 2, "B", "y", "2", None, [2]), ("d", 3, "B", "z", "3", "text", [3])], "doc string, o int, chapter string, section string, subsection_id string, subsection_text string, page_numbers array<int>")
    got = [(r.chapter, r.section, r.subsection_id) for r in extract.merge_empty_headers(rows, "doc", "o").orderBy("seq").collect()]
    assert got == [("A B", "x y", "2"), ("B", "z", "3")]


def test_neighbours_stay_in_their_document(spark):
    df = spark.createDataFrame([("D", "a", 1), ("D", "b", 2), ("D", "c", 3), ("O", "x", 1), (None, "n", 1)], "doc string, id string, o int")
    got = {r.id: (r.seq, r.prev_ids, r.next_ids) for r in chunking.assign_neighbors(df, "doc", "id", "o").collect()}
    assert got == {"a": (0, [], ["b", "c"]), "b": (1, ["a"], ["c"]), "c": (2, ["b", "a"], []), "x": (0, [], []), "n": (0, [], [])}


def test_recursive_splitter_keeps_its_promises():
    import random

    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["word", " ", ". ", "\n", "\n\n", "x" * 30]) for _ in range(80))
        parts = chunking.split_recursively(text, 50, 10)
        assert all(0 < len(p) <= 50 for p in parts)
        at = 0
        for p in parts:  # in order, nothing but blanks lost
            i = text.find(p, max(0, at - 60))
            assert i >= 0
            at = max(at, i + len(p))
        assert set("".join(text.split())) == set("".join("".join(parts).split()))
    assert chunking.split_recursively("", 50, 10) == []


def test_chunks(spark):
    rows = [("D", "sum", "C", "S", "1.1", "short text", [1, 2], 0), ("D", "sum", "C", "S", "1.2", "sentence here. " * 40, [3], 1), ("D", None, None, None, "1.3", "  \n", None, 2), (None, None, None, None, None, "x", None, 3)]
    df = spark.createDataFrame(rows, "document_name string, document_summary string, chapter string, section string, subsection_id string, subsection_text string, page_numbers array<int>, seq int")
    got = chunking.chunk(df, size=200, overlap=20).orderBy("seq", "chunk_index").collect()
    assert got[0].text == "Document: sum\nChapter: C\nSection: S\nshort text" and got[0].page_numbers == "1, 2" and not got[0].is_split and got[0].bm25_text == "short text"
    split = [r for r in got if r.is_split]
    assert len(split) == split[0].total_chunks > 2 and [r.chunk_index for r in split] == list(range(len(split))) and split[0].text.startswith("Context: sum\nChapter: C\nSection: S\nContent: sentence")
    assert got[-1].doc_name == "Unknown Document" and len({r.id for r in got}) == len(got)
    meta = json.loads(chunking.compact(chunking.chunk(df)).orderBy("id").first().meta)
    assert "subsection_text" not in meta and "text" not in meta
    with pytest.raises(Exception, match="metadata too large"):
        chunking.compact(chunking.chunk(df.withColumn("chapter", F.lit("x" * 50_000)))).collect()


def test_fingerprints_change_with_content_and_order(spark):
    make = lambda rows: fingerprints(spark.createDataFrame(rows, "d string, p int, t string"), "d", "p", "t").first().chunk_fingerprint
    a = make([("d", 1, "x"), ("d", 2, "y")])
    assert a == make([("d", 2, "y"), ("d", 1, "x")]) and a != make([("d", 1, "y"), ("d", 2, "x")]) and a != make([("d", 1, "x"), ("d", 2, None)])


LEDGER = "index_name string, namespace string, document string, chunk_fingerprint string, chunk_count int, embedder string, model string, dimension int"


def test_ledger_and_ingestion(spark):
    cur = spark.createDataFrame([("i", "n", "a", "f1", 1, "e", "m", 2), ("i", "n", "b", "f2", 1, "e", "m", 2)], LEDGER)
    empty = ledger.mark(spark.createDataFrame([], LEDGER + ", indexed_at timestamp"), cur.limit(0))
    chunks = spark.createDataFrame([("a", "a1", "text"), ("b", "b1", "text")], "document string, id string, text string")
    embedded = []

    def embed(rows):
        embedded.append(rows.count())
        return rows.select("index_name", "namespace", "document", "id", F.length("text").alias("v"))

    keyword = chunks.limit(0)
    one = ledger.ingest(cur, chunks, None, keyword, empty, embed)
    assert one["vectors"].count() == 2 and one["ledger"].count() == 2 and one["keyword"].count() == 2
    again = ledger.ingest(cur, chunks, one["vectors"], one["keyword"], one["ledger"], embed)
    assert embedded == [2, 0] and again["vectors"].count() == 2 and again["todo"].count() == 0
    changed = cur.withColumn("chunk_fingerprint", F.when(F.col("document") == "a", "new").otherwise(F.col("chunk_fingerprint")))
    third = ledger.ingest(changed, chunks, again["vectors"], again["keyword"], again["ledger"], embed)
    assert embedded[-1] == 1 and third["vectors"].count() == 2 and third["ledger"].count() == 2
    assert {r.document: r.state for r in ledger.pending(changed, one["ledger"]).collect()} == {"a": "replace", "b": "skip"}
    assert ledger.ingest(cur, chunks, one["vectors"], one["keyword"], one["ledger"], embed, new_index=True)["todo"].count() == 2
    kept, n = ledger.clear_index(one["ledger"], "i")
    assert n == 2 and kept.count() == 0


def test_sync_states(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_file string, sha256 string")
    then = spark.createDataFrame([("a", "1"), ("b", "x"), ("z", "9")], "source_file string, sha256 string")
    assert {r.source_file: r.state for r in ledger.sync_states(now, then).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "z": "missing"}


def test_files(spark, tmp_path):
    pages = tmp_path / "md" / "doc"
    pages.mkdir(parents=True)
    for n in ("page_10", "page_9", "cover"):
        (pages / f"{n}.md").write_text(f"text of {n}")
    got = files.markdown_pages(spark, str(tmp_path / "md")).orderBy("page").collect()
    assert [(r.page, r.text) for r in got] == [(1, "text of page_9"), (2, "text of page_10"), (3, "text of cover")]
    cache = tmp_path / "caches"
    cache.mkdir()
    for name, text in (("a_chunks__semantic-v2.json", "old"), ("b_chunks__semantic-v2.json", "new")):
        (cache / name).write_text(json.dumps([{"id": "1", "text": "embed", "metadata": {"subsection_text": text, "bm25_text": "", "page": "1"}}]))
    row = files.chunk_texts(spark, str(cache)).first()
    assert (row.subsection_text, row.full_subsection_text, row.bm25_text, row.chunker) == ("new", "new", "new", "semantic-v2")
    (tmp_path / "q.csv").write_text('Question\n"a, b"\n\n  \nlast\n')
    assert [r.query for r in files.question_list(spark, str(tmp_path / "q.csv")).collect()] == ["a, b", "last"]
    assert files.question_list(spark, str(tmp_path / "q.csv"), 1).count() == 1
    (tmp_path / "r.csv").write_text("Question,Answer\n q ,one\nq,two\n ,x\n")
    assert [(r.question, r.answer) for r in files.reference_list(spark, str(tmp_path / "r.csv")).collect()] == [("q", "two")]
    assert files.reference_list(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "res.csv").write_text("query,score\nx,4.5\ny,n/a\n")
    assert [r.score_number for r in files.result_list(spark, str(tmp_path / "res.csv")).collect()] == [4.5, None]
    (tmp_path / "one.PDF").write_bytes(b"a\fb")
    parsed = files.parsed_pages(files.binary_files(spark, str(tmp_path)), lambda b: b.decode().split("\f"))
    assert [(r.doc, r.page, r.text) for r in parsed.orderBy("page").collect()] == [("one", 1, "a"), ("one", 2, "b")]
    assert ledger.file_digests(files.binary_files(spark, str(tmp_path))).first().source_file == "one.PDF"


def test_versioned_table_and_artifacts(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), "id string, source_file string, x int")
    assert t.create() and not t.create()
    t.upsert(spark.createDataFrame([("a", "f", 1), ("b", "f", 2)], t.schema), ["id"])
    t.replace_sources(spark.createDataFrame([("c", "f", 3)], t.schema), "source_file", "id")
    assert [tuple(r) for r in t.read().collect()] == [("c", "f", 3)]
    t.delete(spark.createDataFrame([("c",)], "id string"))
    assert t.read().count() == 0
    assert t.vacuum(1) == 3 and t.read().count() == 0 and t.vacuum(1) == 0
    packed = sinks.packed_artifact(spark.createDataFrame([("c", "n", bytearray(b"data"))], "chunker string, artifact_name string, content binary"))
    assert gzip.decompress(packed.first().payload) == b"data"
    assert bytes(files.restored_artifacts(packed).first().content) == b"data"
    with pytest.raises(Exception, match="digest differs"):
        files.restored_artifacts(packed.withColumn("sha256", F.lit("0"))).collect()
    assert sinks.changed_artifacts(packed, packed).count() == 0


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.slug(F.lit("  Semantic v2! "))) == "semantic_v2"
    with pytest.raises(Exception, match="no table name"):
        one(T.slug(F.lit("--")))
    assert one(T.score_lines(F.lit("1: 8\n2 - 11\nx\n1. 3"), 3)) == [3.0, 10.0, 5.0]
    assert one(T.engine_url(F.lit("postgres://h/db"))) == "postgresql+psycopg://h/db" and one(T.driver_url(F.lit("postgresql+psycopg://h/db"))) == "postgresql://h/db"
    assert one(T.rerank_text(F.lit(None), F.lit("x\n"))) == "x" and one(T.page_list(F.array(F.lit(1), F.lit(2)))) == "1, 2"
    assert one(T.jaccard(T.token_set(F.lit("a b c")), T.token_set(F.lit("B c d")))) == 0.5 and one(T.jaccard(T.token_set(F.lit("")), T.token_set(F.lit("a")))) == 0.0
    assert one(T.combo_label(F.lit("a"), F.lit("b"), two_call=F.lit(True))) == "a__b__tc1"


def test_judging(spark):
    rows = spark.createDataFrame([("a", 4, 0, 5, 0, 3), ("a", 2, 0, 0, 0, 0), ("b", 5, 5, 5, 5, 5), ("c", 0, 0, 0, 0, 0)], "experiment string, ctx_precision int, ctx_sufficiency int, faithfulness int, correctness int, answer_relevance int")
    c = judge.composites(rows)
    assert [(r.retrieval_score, r.generation_score, r.overall_score) for r in c.collect()] == [(4.0, 4.0, 4.0), (2.0, 0.0, 2.0), (5.0, 5.0, 5.0), (0.0, 0.0, 0.0)]
    s = {(r.experiment, r.metric): r for r in judge.summary(c, judge.METRICS, "experiment").collect()}
    assert (s["a", "ctx_precision"].mean, s["a", "ctx_precision"].std, s["a", "ctx_precision"].n) == (3.0, 1.0, 2) and ("c", "ctx_precision") not in s
    board = judge.leaderboard(c).orderBy("place").collect()
    assert [r.experiment for r in board] == ["b", "a", "c"] and board[2].overall_score is None
    duel = {r.metric: r.winner for r in judge.compare(judge.summary(c, judge.METRICS, "experiment"), "a", "b").collect()}
    assert duel["ctx_precision"] == "b" and duel["ctx_sufficiency"] == "tie"
    v = spark.createDataFrame([(1, False, "A", 4), (1, True, "B", 3), (2, False, "A", 4), (2, True, "A", 4), (3, False, None, 0), (3, True, "A", 1), (4, False, "tie", 2), (4, True, "tie", 4)], "pair_id int, swapped boolean, winner string, confidence int")
    assert [(r.winner, r.confidence, r.position_bias) for r in judge.merge_swapped(v).orderBy("pair_id").collect()] == [("A", 3.5, False), ("tie", 1.0, True), ("JUDGE_ERROR", 0.0, False), ("tie", 3.0, False)]
    grid = judge.grid(spark, ["e"], ["bm25", "vector"], ["none"], ["s"], [False, True])
    assert grid.count() == 4 and judge.runnable(grid, False).count() == 2
    union = judge.union_of_results(spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([("x",)], "a string"))
    assert union.columns == ["a", "b"] and sorted(map(tuple, union.collect())) == [("", "1"), ("x", "")]


def test_feedback(spark):
    ratings = spark.createDataFrame([("1", "r1", "u", 5, 4, None, " ok ", 1), ("2", "r1", "u", 3, 9, 2, "", 2), ("3", "r2", "v", 1, 1, 1, None, None)], "id string, response_id string, rater_id string, retrieval_relevance int, completeness int, correctness int, comment_text string, updated_at int")
    latest = feedback.latest_ratings(ratings)
    assert sorted((r.id, r.retrieval_relevance, r.completeness, r.comment_text) for r in latest.collect()) == [("2", 3, None, None), ("3", 1, 1, None)]
    responses = spark.createDataFrame([("r1", "bm25", "q"), ("r2", "bm25", "q"), ("r3", "vector", "q"), ("r3", "vector", "q")], "id string, retriever string, question string")
    assert tuple(feedback.totals(responses, latest).first()) == (3, 2, 2, 66.7)
    assert tuple(feedback.totals(responses.limit(0), latest.limit(0)).first()) == (0, 0, 0, 0.0)
    by = {r.retriever: tuple(r)[1:] for r in feedback.by_retriever(responses, latest).collect()}
    assert by == {"bm25": (2, 2, 2.0, 1.0, 1.5), "vector": (1, 0, 0.0, 0.0, 0.0)}
    cells = {(r.criterion, r.grade): r.n for r in feedback.criterion_stats(latest).collect()}
    assert len(cells) == 15 and cells["retrieval_relevance", 3] == 1 and cells["correctness", 5] == 0
    assert feedback.recent(responses, latest, 0).count() == 1


def test_adaptive_batches_and_retries():
    class Full(Exception):
        status_code = 429

    sizes, waits = [], []

    def call(batch):
        sizes.append(len(batch))
        if len(batch) > 4:
            raise Full("too many")
        return batch

    assert [x for b in calls.adaptive(list(range(11)), call, calls.Policy(size=8), waits.append) for x in b] == list(range(11))
    assert sizes == [8, 4, 4, 3] and waits == [5.0]
    with pytest.raises(ValueError):
        list(calls.adaptive([1], lambda b: (_ for _ in ()).throw(ValueError("other")), calls.Policy(), waits.append))
    with pytest.raises(Full):  # at the least size it is raised
        list(calls.adaptive([1], lambda b: (_ for _ in ()).throw(Full("too many")), calls.Policy(), waits.append))
    tries = []
    assert calls.retried(lambda: tries.append(1) or (1 / 0 if len(tries) < 2 else "done"), sleep=waits.append) == "done"
    with pytest.raises(TimeoutError):
        calls.retried(lambda: time.sleep(0.5), 2, waits.append, timeout=0.01)
    with pytest.raises(ValueError):
        calls.Policy(size=0)


def test_capacity_errors_are_told_by_code_message_and_cause():
    class Coded(Exception):
        def code(self):
            return "StatusCode.RESOURCE_EXHAUSTED"

    outer = ValueError("batch failed")
    outer.__cause__ = RuntimeError("limit of 40000 tokens per minute")
    ring = ValueError("a")
    ring.__context__ = ring
    told = [calls.is_capacity_error(e) for e in (Coded("no"), outer, RuntimeError("413 documents stored"), RuntimeError("no quota given"), ring, RuntimeError("Request too large"))]
    assert told == [True, True, False, False, False, True]


def test_structured_replies(spark):
    rows = spark.createDataFrame([('```json\n{"sufficient": false, "followup_queries": ["a"]}\n```',), ("sorry",), (None,)], "r string")
    got = [x.g for x in rows.select(calls.structured(F.col("r"), "sufficient boolean, followup_queries array<string>").alias("g")).collect()]
    assert got[0].sufficient is False and got[0].followup_queries == ["a"] and got[2] is None
    assert got[1] is None or got[1].sufficient is None


def test_registry_and_offline_models(spark):
    r = Registry("thing")
    r.add(" A ")(1)
    assert r.get("a") == 1
    with pytest.raises(KeyError, match="unknown thing"):
        r.get("b")
    assert "hashing" in EMBEDDERS.names
    v = [x.v for x in spark.createDataFrame([("licence fee",), ("licence fee",), (None,)], "t string").select(hashing_embedder(F.col("t"), 8).alias("v")).collect()]
    assert v[0] == v[1] and sum(x * x for x in v[0]) == pytest.approx(1, abs=1e-6) and set(v[2]) == {0.0}
    out = calls.map_model(spark.createDataFrame([("a",), ("bb",)], "t string"), lambda: lambda b: [len(x) for x in b], "t", "n", "int")
    assert sorted(x.n for x in out.collect()) == [1, 2]


def test_pipeline_end_to_end(spark):
    from clauseworks.models import registry
    from clauseworks.operators import rerank, retrieval

    docs = spark.createDataFrame([(f"c{i}", "D", "C", f"S{i % 2}", str(i), t) for i, t in enumerate(["annual licence fee of the tower", "annual report deadline", "spectrum lease term", "licence fee waiver", "licence fee waiver"])], "id string, doc_name string, chapter string, section string, subsection_id string, text string")

    def retrieve(v):
        q = v.select(F.concat_ws(":", "query_id", "variant_no").alias("query_id"), F.col("variant_query").alias("query"))
        h = retrieval.keyword_search(q, docs, "id", "text", 10).join(docs, "id")
        part = F.split("query_id", ":")
        return h.withColumn("pos", F.get(part, F.lit(1)).cast("int") * 1000 + F.col("rank")).withColumn("query_id", F.get(part, F.lit(0)).cast("int"))

    p = pipeline.Pipeline(strategy=lambda q: retrieval.variants(q, registry.diversify(q)), retrieve=retrieve, rerank=lambda h, queries, raw: rerank.rerank_none(h).withColumn("pos", F.col("rank")), generate=lambda c: c.select("query_id", F.col("context").alias("answer")))
    out = p.run(spark.createDataFrame([(1, "annual licence fee"), (2, "zebra")], "query_id int, query string"))
    answers = {r.query_id: r.answer for r in out["answers"].collect()}
    assert answers[2] == pipeline.NO_ANSWER and "annual licence fee of the tower" in answers[1]
    assert out["final"].where("query_id = 1").count() == len({r.text for r in out["final"].where("query_id = 1").collect()})


def test_stream_ingestion_runs_each_file_once(spark, tmp_path):
    from clauseworks.streaming.ingest import ingest_stream

    src = str(tmp_path / "in")
    spark.range(5).write.parquet(src)
    seen = []
    for _ in range(2):
        ingest_stream(spark, src, "id bigint", lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [5]
