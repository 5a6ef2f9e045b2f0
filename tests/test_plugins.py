"""Plug-ins by name, prompts, saved indexes."""

import pytest
from pyspark.sql import functions as F

from clauseworks.models import prompts, registry
from clauseworks.operators import chunking, index, retrieval
from clauseworks.plans import plugins
from clauseworks.schema import Config


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["annual licence fee of the tower", "annual report deadline", "spectrum lease term", "licence fee waiver for small operators"]
    df = spark.createDataFrame([(f"c{i}", "D", "C", f"S{i % 2}", t) for i, t in enumerate(texts)], "id string, doc_name string, chapter string, section string, text string")
    df = df.withColumn("vector", registry.hashing_embedder(F.col("text")))
    return chunking.assign_neighbors(df, "doc_name", "id", "id")


@pytest.mark.parametrize("name", ["bm25", "vector", "hybrid", "hierarchical"])
def test_retrievers_find_the_right_chunk(spark, chunks, name):
    q = spark.createDataFrame([(1, "annual licence fee of the tower"), (2, "spectrum lease term")], "query_id int, query string").withColumn("vector", registry.hashing_embedder(F.col("query")))
    out = registry.RETRIEVERS.get(name)(q, chunks, Config(top_k=3))
    best = {r.query_id: r.id for r in out.where("rank = 1").collect()}
    assert best == {1: "c0", 2: "c2"}


@pytest.mark.parametrize("name", ["none", "rrf", "llm"])
def test_rerankers_by_name(spark, chunks, name):
    q = spark.createDataFrame([(1, "licence fee waiver")], "query_id int, query string")
    hits = plugins.with_positions(registry.RETRIEVERS.get("bm25")(q, chunks).join(chunks.select("id", "text"), "id"))
    out = registry.RERANKERS.get(name)(hits.drop("rank"), q).orderBy("rank").collect()
    assert out[0].id == "c3" and all(r.relevance_score is not None for r in out)


def test_names_are_checked():
    plugins.check_names("hashing", "vector", "none", "simple", ("faithfulness",))
    with pytest.raises(KeyError, match="unknown reranker"):
        plugins.check_names("hashing", "vector", "nope", "simple")


def test_offline_judges(spark):
    rows = spark.createDataFrame([("a b", "a b c", "a b", "a b"), ("a b", "", None, None)], "query string, context string, response string, reference string")
    out = registry.judged(rows, list(registry.OFFLINE_JUDGES)).collect()
    assert (out[0].ctx_precision, out[0].faithfulness, out[0].correctness, out[0].answer_relevance) == (5, 5, 5, 5)
    assert (out[1].ctx_precision, out[1].faithfulness, out[1].correctness, out[1].answer_relevance) == (0, 0, 0, 0)


def test_prompts(spark):
    assert prompts.render("Q: {q}", q=1) == "Q: 1"
    with pytest.raises(KeyError):
        prompts.render("{missing}")
    row = spark.range(1).select(prompts.rendered("Q: {q}!", q=F.lit("x")).alias("p"), prompts.shortened(F.lit("abc"), 2).alias("s")).first()
    assert row.p == "Q: x!" and row.s == "ab"


def test_saved_index_gives_the_same_scores(spark, chunks, tmp_path):
    q = spark.createDataFrame([(1, "annual licence fee")], "query_id int, query string")
    index.save(str(tmp_path / "ix"), chunks, "id", "text")
    post, terms, n, average = index.load(spark, str(tmp_path / "ix"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert n == 4 and rows(retrieval.keyword_scores(q, post, terms, average)) == rows(retrieval.keyword_search(q, chunks, "id", "text"))


@pytest.mark.parametrize("retriever", ["bm25", "vector", "hybrid", "hierarchical"])
@pytest.mark.parametrize("reranker", ["rrf", "llm"])
def test_named_parts_fit_the_pipeline(spark, retriever, reranker):
    from clauseworks.plans import runner

    texts = ["annual licence fee of the tower", "annual report deadline", "spectrum lease term", "licence fee waiver for schools", "a tower is shared by two carriers"]
    subs = spark.createDataFrame([("D", None, "C", f"S{i % 2}", str(i), t, [i], i) for i, t in enumerate(texts)], "document_name string, document_summary string, chapter string, section string, subsection_id string, subsection_text string, page_numbers array<int>, seq int")
    chunks = runner.indexed(subs)
    queries = spark.createDataFrame([(1, "annual licence fee and spectrum lease"), (2, "zebra")], "query_id int, query string")

    def analyse(contexts):
        return contexts.select("query_id", (F.col("query_id") != 1).alias("sufficient"), F.array(F.lit("tower shared by carriers")).alias("followup_queries"))

    out = runner.retrieve(queries, chunks, retriever=retriever, reranker=reranker, strategy="decompose", config=Config(top_k=3, rerank_top_k=4, two_call=True, relevance_threshold=0.0), analyse=analyse, generate=lambda c: c.select("query_id", F.col("context").alias("answer")))
    told = {r.query_id: r for r in out["counts"].collect()}
    assert told[1].variants == 3 and told[1].followups == 1 and told[1].final == min(4, told[1].merged) and told[1].raw >= told[1].merged > 1
    assert {r.id for r in out["final"].where("query_id = 1").collect()} <= {r.id for r in chunks.collect()}
    assert out["final"].where("query_id = 1").agg(F.max("rank")).first()[0] <= 4


def test_a_failed_ingestion_is_made_again(spark, tmp_path):
    from clauseworks.plans import runner
    from clauseworks.sources.sinks import VersionedTable

    key = "index_name string, namespace string, document string"
    made = lambda name, cols: VersionedTable(spark, str(tmp_path / name), cols)
    tables = {"vectors": made("v", f"{key}, id bigint, vector array<float>"), "keyword": made("k", f"{key}, id bigint, text string"), "ledger": made("l", f"{key}, chunk_fingerprint string, chunk_count int, embedder string, model string, dimension int, indexed_at timestamp")}
    current = lambda ns, *docs: spark.createDataFrame([("i", ns, d, f"fp{d}", 2, "e", "m", 4) for d in docs], f"{key}, chunk_fingerprint string, chunk_count int, embedder string, model string, dimension int")
    chunks = spark.createDataFrame([(d, n, f"text {d}{n}") for d in "ab" for n in (1, 2)], "document string, id bigint, text string")
    asked = []

    def embed(rows):
        asked.append(rows.count())
        return rows.withColumn("vector", F.array(F.lit(1.0).cast("float")))

    def broken(rows):
        return rows.withColumn("vector", F.array(F.raise_error(F.lit("no quota")).cast("float")))

    with pytest.raises(Exception, match="no quota"):
        runner.ingest(current("n", "a"), chunks, tables, broken)
    assert not tables["ledger"].exists and not tables["keyword"].exists
    assert [r.state for r in runner.ingest(current("n", "a"), chunks, tables, embed).collect()] == ["new"]
    assert {(r.document, r.state) for r in runner.ingest(current("n", "a", "b"), chunks, tables, embed).collect()} == {("a", "skip"), ("b", "new")}
    runner.ingest(current("other", "a"), chunks, tables, embed)  # another namespace leaves the first one's rows
    assert asked == [2, 2, 2]
    for t in ("vectors", "keyword"):
        assert sorted(tuple(r) for r in tables[t].read().groupBy("namespace", "document").count().collect()) == [("n", "a", 2), ("n", "b", 2), ("other", "a", 2)]
    assert {(r.document, r.state) for r in runner.ingest(current("n", "a"), chunks, tables, embed, new_index=True).collect()} == {("a", "new")}
    assert tables["ledger"].read().count() == 1
