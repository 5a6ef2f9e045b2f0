"""Sweeps share what their experiments have in common and move no texts; tables with few repeated keys aren't shuffled whole."""

import os

import pytest

import __spark_entry__ as entry
from clauseworks.operators import index, judge, retrieval
from clauseworks.plans import runner
from clauseworks.schema import Config

rows = lambda df: sorted(map(tuple, df.collect()))


def test_sweep_shares_retrieval_and_gives_each_experiments_lists(spark, monkeypatch):
    texts = [f"licence fee of tower {i % 7} and lease {i}" for i in range(20)] + ["annual fee. " * 30, "annual fee. " * 30]
    subs = spark.createDataFrame([("D" if i % 2 else None, None, "C", "S", str(i), t, [i], i // 2 * 2) for i, t in enumerate([*texts, *texts])], "document_name string, document_summary string, chapter string, section string, subsection_id string, subsection_text string, page_numbers array<int>, seq int")
    config = Config(top_k=8, rerank_top_k=5, relevance_threshold=0.0, chunk_size=100, chunk_overlap=10)
    chunks = runner.indexed(subs, config=config)
    made = chunks.toPandas()
    assert (made.bm25_text == made.subsection_text).all() and made.is_split.any() and made.id.is_unique
    assert all(e.startswith("Context: " if s else "Document: ") and e.endswith(t) for e, s, t in zip(made.embedded, made.is_split, made.subsection_text))
    assert all(t == (f if s else p) for t, s, f, p in zip(made.text, made.is_split, made.full_subsection_text, made.subsection_text))
    queries = spark.createDataFrame([(1, "annual licence fee"), (2, "tower 3 lease")], "query_id int, query string")
    combos = judge.grid(spark, ["hashing"], ["vector", "hybrid"], ["none", "rrf"], ["simple"], [False])
    asked, search = [], retrieval.vector_search
    monkeypatch.setattr(retrieval, "vector_search", lambda *a, **b: (asked.append(1), search(*a, **b))[1])
    got = rows(runner.sweep(queries, chunks, combos, config))
    assert len(asked) == 2  # two retrievers; once for each of four experiments before
    want = []
    for c in judge.runnable(combos, True).collect():
        out = runner.pipeline(chunks, c.embedder, c.retriever, c.reranker, c.strategy, config=config).run(queries)["final"]
        want += [(c.label, r.query_id, r.id, r["rank"], float(r.relevance_score)) for r in out.collect()]
    assert got == sorted(want) and len({r[0] for r in got}) == 4


def test_only_rows_of_repeated_keys_are_moved(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in [*range(100), 3, 3, None, None]], "id int, text string")
    assert "Exchange" not in index.postings(docs.where("id > 3"), "id", "text")._jdf.queryExecution().executedPlan().toString()
    seen = []
    pick = lambda df: (seen.append(df.count()), df.dropDuplicates(["id"]))[1]
    assert index.one_each(docs, "id", pick).count() == 101 and seen == [5]
    monkeypatch.setattr(index, "REPEATED_KEYS", 1)
    assert index.one_each(docs, "id", pick).count() == 101 and seen == [5, 104]


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="no test tables here")
@pytest.mark.parametrize("name", ["hybrid_rrf", "keyword_refreshed"])
def test_provisions_are_not_shuffled_whole(spark, monkeypatch, name):
    seen, first = [], index.keep_first
    monkeypatch.setattr(index, "keep_first", lambda df, *rest: (seen.append(df.count()), first(df, *rest))[1])
    entry.queries()[name](spark, "/root/testdata/sf0.01")
    assert max(seen) < 100
