"""Queries over the reference questions ask all of them."""

import math
import os

import pytest

import __spark_entry__ as entry
from clauseworks.functions import keywords
from clauseworks.operators import judge, retrieval
from clauseworks.plans import runner
from clauseworks.schema import Config

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_bm25_topk_asks_every_question(spark, tmp_path):
    """Also a number with two questions and a question without a number."""
    import duckdb

    con = duckdb.connect()
    os.symlink(f"{DATA}/subsections.parquet", tmp_path / "subsections.parquet")
    con.execute(f"create view subsections as select * from '{DATA}/subsections.parquet'")
    con.execute(f"create table reference_answers as select * from '{DATA}/reference_answers.parquet'")
    con.execute("insert into reference_answers (ref_id, question) values (7, 'annual licence fee'), (null, 'annual licence'), (90001, null), (90002, 'the')")
    con.execute(f"copy reference_answers to '{tmp_path}/reference_answers.parquet' (format parquet)")
    got = entry.queries()["bm25_topk"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()['bm25_topk']})").fetchall()
    rows = lambda found: sorted((-1 if q is None else q, i, round(s, 6), r) for q, i, s, r in found)
    assert rows(got.collect()) == rows(want)
    numbers = {r[0] for r in rows(want)}
    assert {7, -1} < numbers and len({n for n in numbers if n % 20}) > 20


def test_experiment_sweep_asks_every_question(spark, monkeypatch):
    asked, sweep = [], runner.sweep
    monkeypatch.setattr(runner, "sweep", lambda queries, *rest: (asked.extend(r.query_id for r in queries.collect()), sweep(queries, *rest))[1])
    assert entry.queries()["experiment_sweep"](spark, DATA).collect() == [(4, True)]
    there = spark.read.parquet(f"{DATA}/reference_answers.parquet").select("ref_id").distinct().collect()
    assert sorted(asked) == sorted(r.ref_id for r in there)


def test_equal_questions_are_searched_once(spark, monkeypatch):
    subs = spark.createDataFrame([("D", None, "C", "S", str(i), f"licence fee of tower no{i}", [i], i) for i in range(12)], "document_name string, document_summary string, chapter string, section string, subsection_id string, subsection_text string, page_numbers array<int>, seq int")
    chunks = runner.indexed(subs)
    queries = spark.createDataFrame([(1, "tower no3"), (2, "tower no3"), (3, None), (4, None), (5, "tower no4")], "query_id int, query string")
    seen, search = [], retrieval.vector_search
    monkeypatch.setattr(retrieval, "vector_search", lambda asked, *rest: (seen.append(asked.count()), search(asked, *rest))[1])
    out = runner.sweep(queries, chunks, judge.grid(spark, ["hashing"], ["hybrid"], ["none"], ["simple"], [False]), Config(top_k=4, relevance_threshold=0.0))
    lists = {q: [(r.id, r.relevance_score) for r in out.where(f"query_id = {q}").orderBy("rank").collect()] for q in range(1, 6)}
    assert seen == [3] and lists[1] == lists[2] != lists[5] and lists[3] == lists[4] and all(map(len, lists.values()))


def test_bounded_keyword_search_equals_all_scores(spark, monkeypatch):
    """Many slices and merges: the lists are those of every pair's score."""
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(60)], k=r.randint(1, 30)))) for i in range(900)]
    asks = [(i, " ".join(r.choices(words, k=r.randint(1, 6)))) for i in range(300)]
    monkeypatch.setattr(keywords, "FIRST_SLICES", (20, 50))  # tasks of a local session take them with the kernel
    asked, table = spark.createDataFrame(asks, "query_id int, query string"), spark.createDataFrame(docs, "id int, text string")
    got = {(x.query_id, x.id): (x.score, x["rank"]) for x in retrieval.keyword_search(asked, table, "id", "text", 5).collect()}
    tokens = {i: t.split() for i, t in docs}
    average, df = sum(map(len, tokens.values())) / 900, {w: sum(w in t for t in tokens.values()) for w in words}
    raw = {w: math.log((900 - n + 0.5) / (n + 0.5)) for w, n in df.items() if n}
    mean = 0.25 * sum(raw.values()) / len(raw)
    want = {}
    for q, text in asks:
        every = []
        for i, t in tokens.items():
            score = sum((mean if raw[w] < 0 else raw[w]) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in text.split() if w in t)
            every.append((-round(score, 6), i))
        want |= {(q, i): (-s, n + 1) for n, (s, i) in enumerate(sorted(every)[:5]) if s < 0}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(v[0] - want[k][0]) < 2e-6 for k, v in got.items())


def test_queries_without_words_have_the_smallest_ids(spark):
    found = retrieval.vector_search(spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "query_id int, vector array<float>"), spark.createDataFrame([(i, [float(i % 7 - 3), 1.0]) for i in range(90, 0, -1)], "id int, vector array<float>"), 3)
    lists = {q: [(r.id, r.score) for r in found.where(f"query_id = {q}").orderBy("rank").collect()] for q in (1, 2, 3)}
    assert lists[1] == lists[2] == [(1, 0.0), (2, 0.0), (3, 0.0)] and [i for i, _ in lists[3]] == [6, 13, 20]
