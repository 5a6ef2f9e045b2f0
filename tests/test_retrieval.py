"""Retrieval, hierarchy, reranking and rounds on tiny fixtures with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clauseworks.functions import text as T
from clauseworks.functions import vectors as V
from clauseworks.operators import hierarchy, index, rerank, retrieval, rounds
from clauseworks.schema import Config


def test_keyword_tokens(spark):
    df = spark.createDataFrame([("The Fee of Tk.25,000 under 1.01 is a cross-border X fee",), (None,), ("",)], "t string")
    assert [r.w for r in df.select(T.keyword_tokens(F.col("t")).alias("w")).collect()] == [["fee", "tk.25", "000", "under", "1.01", "cross-border", "fee"], [], []]


def okapi(docs, query):
    """Scores from the formula, in plain Python."""
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    vocab = {w for d in docs for w in d}
    df = {w: sum(w in d for d in docs) for w in vocab}
    idf = {w: math.log(n - df[w] + 0.5) - math.log(df[w] + 0.5) for w in vocab}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: eps if v < 0 else v for w, v in idf.items()}
    return [sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query if w in idf) for d in docs]


def test_keyword_search_agrees_with_the_formula(spark):
    rng = random.Random(4)
    words = ["fee", "licence", "annual", "tower", "audit", "common"]
    docs = [[rng.choice(words) for _ in range(rng.randint(1, 12))] + (["common"] if i % 4 else []) for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(3, " ".join(docs[3]))], "id long, text string")
    q = ["annual", "fee", "fee", "common", "absent"]
    got = {r.id: r.score for r in retrieval.keyword_search(spark.createDataFrame([(1, " ".join(q)), (2, "the of")], "query_id long, query string"), df, "id", "text", 100).collect()}
    want = okapi(docs, q)
    assert got == {i: pytest.approx(s, abs=2e-6) for i, s in enumerate(want) if round(s, 6) > 0}


def test_keyword_index_merge_and_remove(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    b = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "id string, x int")
    merged = index.merge_new(a, b)
    assert sorted(map(tuple, merged.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted(r.id for r in index.remove(merged, spark.createDataFrame([("a",), ("zz",)], "id string")).collect()) == ["b", "c"]
    up = index.upsert(a, spark.createDataFrame([("b", 7), ("b", 8)], "id string, x int"), ["id"], "x")
    assert sorted(map(tuple, up.collect())) == [("a", 1), ("b", 8)]


def test_cosine_and_normalisation(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all(r.c == r.want for r in df.select("want", V.cosine(F.col("a"), F.col("b")).alias("c")).collect())
    assert [list(r.n or []) for r in df.select(V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("n")).limit(1).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)]]


@pytest.mark.parametrize("block", [2, 1000])
def test_vector_search_agrees_with_brute_force_in_any_blocks(spark, block):
    rng = random.Random(9)
    rows = [(i, [float(rng.choice((-1, 0, 1))) for _ in range(4)], i % 2) for i in range(120)] + [(500, None, 0)]
    v = spark.createDataFrame(rows, "id long, vector array<float>, label int").repartition(5)
    q = v.where("id % 30 = 0").withColumnRenamed("id", "query_id")

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    for same in (None, "label"):
        got = {(r.query_id, r["rank"]): (r.id, r.score) for r in V.exact_top_k(q, v, 7, same, block).collect()}
        for qi, qv, ql in rows:
            if qi % 30 == 0 and qi < 500:
                best = sorted((-cos(qv, x or [0] * 4), i) for i, x, lab in rows if not same or lab == ql)[:7]
                assert [got[qi, k + 1] for k in range(7)] == [(i, -s) for s, i in best]


def test_int8_vectors(spark):
    import base64

    df = spark.createDataFrame([(base64.b64encode(bytes([1, 255, 128])).decode(),), (None,)], "v string")
    assert [r.f for r in df.select(V.decode_int8(F.col("v")).alias("f")).collect()] == [[1.0, -1.0, -128.0], None]


LISTS = "query_id int, id string, list_no int, rank0 int"


def test_fusion(spark):
    rows = [(1, "a", 0, 0), (1, "b", 0, 1), (1, "b", 1, 0), (1, "c", 1, 1), (1, "", 1, 2), (1, None, 1, 3)]
    got = retrieval.fuse(spark.createDataFrame(rows, LISTS)).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"] and got[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)


def test_variants(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "query_id int, query string")
    g = spark.createDataFrame([(1, ["p", "q", " "]), (2, ["y", "r"])], "query_id int, queries array<string>")
    got = lambda df: sorted((r.query_id, r.variant_no, r.variant_query) for r in df.collect())
    assert got(retrieval.variants(q, g, True)) == [(1, 0, "p"), (1, 1, "q"), (1, 2, "x"), (2, 0, "y"), (2, 1, "r"), (3, 0, "z")]
    assert got(retrieval.variants(q)) == [(1, 0, "x"), (2, 0, "y"), (3, 0, "z")]


HITS = "query_id int, id string, doc_name string, chapter string, section string, score double, pos int, text string"
FIVE = [(1, "a", "D1", "C1", "Licensing", 0.9, 0, "t"), (1, "b", "D1", "C1", "Licensing", 0.7, 1, "t"), (1, "c", "D1", "C1", "Tariff", 0.6, 2, "t"), (1, "d", "D2", "C2", "Other", 0.2, 3, "t"), (1, "e", "D2", "C2", "Other", 0.15, 4, "t")]


def test_group_ranks_and_levels(spark):
    hits = spark.createDataFrame(FIVE, HITS)
    groups = hierarchy.group_scores(hits, "section", "score").orderBy("group_rank").collect()
    assert (groups[0].doc_name, groups[0].chapter, groups[0].section) == ("D1", "C1", "Licensing") and groups[0].group_score == pytest.approx(0.9 + 0.25 * 0.8)
    kept = hierarchy.apply_levels(hits, (("doc_name", 1), ("chapter", 1), ("section", 1))).orderBy("rank").collect()
    assert [(r.id, r.base_score) for r in kept] == [("a", 0.9), ("b", 0.7)] and kept[0].score == pytest.approx(1.2) and kept[0].hier_section_rank == 0


def test_classes_prefix_and_splice(spark):
    df = spark.createDataFrame([(0.9, [0.8, 0.2, 0.9]), (0.2, []), (0.5, [0.5, None, 0.9])], "s double, n array<double>")
    got = df.select(hierarchy.relevance_class(F.col("s")).alias("c"), hierarchy.passing(F.col("n"), 0.4).alias("k")).collect()
    assert [(r.c, r.k) for r in got] == [("high", 1), ("low", 0), ("medium", 1)]
    text = hierarchy.splice(F.array(F.lit("p1"), F.lit("p2")), F.lit("ACT"), F.array(F.lit("n1"), F.lit("")))
    assert df.select(text.alias("t")).first().t == "p2\n\np1\n\nACT\n\nn1"


def test_neighbours_are_spliced_up_to_the_first_unlike_one(spark):
    hits = spark.createDataFrame([(1, "h", 0.50, ["p1", "px"], ["n1", "n2"], "ACT"), (1, "top", 0.9, ["p1"], [], "T")], "query_id int, id string, base_score double, prev_ids array<string>, next_ids array<string>, text string")
    vec = spark.createDataFrame([("p1", [1.0, 0.0]), ("n1", [0.0, 1.0]), ("n2", [1.0, 0.0])], "id string, vector array<double>")
    texts = spark.createDataFrame([("p1", "before"), ("n1", "after"), ("n2", "later"), ("px", "gone")], "id string, text string")
    out = {r.id: r for r in hierarchy.neighbours(hits, vec, texts, spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")).collect()}
    assert out["h"].text == "before\n\nACT" and list(out["h"].neighbor_added.prev) == [1.0] and list(out["h"].neighbor_added.next) == []
    assert out["top"].text == "T" and out["top"].neighbor_added is None


def test_siblings_leak_between_documents_unless_qualified(spark):
    hits = spark.createDataFrame([FIVE[0]], HITS)
    cand = spark.createDataFrame([("a", "D1", "C1", "Licensing", [1.0, 0.0]), ("s", "D1", "C1", "Licensing", [0.9, 0.1]), ("x", "D9", "C9", "Licensing", [0.5, 0.5])], "id string, doc_name string, chapter string, section string, vector array<double>")
    qv = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    ids = lambda q: {r.id: r.sibling_expanded for r in hierarchy.siblings(hits, cand, qv, qualified=q).collect()}
    assert ids(False) == {"a": False, "s": True, "x": True} and ids(True) == {"a": False, "s": True}


def test_dedupe_keeps_best_at_first_place(spark):
    rows = [(1, "a", "D", "C", "S", 0.2, 0, "x"), (1, "b", "D", "C", "S", 0.9, 1, "y"), (1, "c", "D", "C", "S", 0.5, 2, "x"), (1, "d", "D", "C", "S", 0.5, 3, "x"), (1, "e", "D", "C", "S", 1.0, 4, " "), (1, "f", "D", "C", "S", None, 5, "z"), (1, "g", "D", "C", "S", 1.0, 6, None)]
    got = [(r.id, r.pos) for r in rerank.dedupe(spark.createDataFrame(rows, HITS)).orderBy("pos").collect()]
    assert got == [("c", 0), ("b", 1), ("f", 5)]


def test_rerankers_and_filter(spark):
    hits = spark.createDataFrame(FIVE, HITS)
    none = rerank.rerank_none(hits, 2).orderBy("rank").collect()
    assert [r.id for r in none] == ["a", "b"] and none[0].relevance_score == 0.9 and none[0]["index"] == 0
    fused = rerank.rerank_fused(hits).orderBy("rank").collect()
    assert [r["index"] for r in fused] == [0, 1, 2, 3, 4] and fused[0].relevance_score == pytest.approx(1 / 61, abs=1e-8)
    scores = spark.createDataFrame([(1, "d", 9.0), (1, "a", 2.0)], "query_id int, id string, model_score double")
    got = rerank.rerank_scored(hits, scores, head=4).orderBy("rank").collect()
    assert [(r.id, r.relevance_score) for r in got] == [("d", 0.9), ("b", 0.5), ("c", 0.5), ("a", 0.2)]
    assert rerank.relevance_filter(rerank.rerank_none(hits), 0.5).count() == 3 and rerank.relevance_filter(hits, 0).count() == 5


def test_mmr_agrees_with_brute_force(spark):
    rng = random.Random(6)
    rows = [(q, f"{q}-{i}", "D", "C", "S", round(rng.random(), 1), i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 5)))) for q in range(6) for i in range(12)]
    got = {}
    for r in rerank.diversify(spark.createDataFrame(rows, HITS), 0.7, 5).collect():
        got.setdefault(r.query_id, {})[r.pick] = r.id
    for q in range(6):
        left = [(i, s, set(t.split())) for qq, i, _, _, _, s, _, t in rows if qq == q]
        out = []
        while left and len(out) < 5:
            def value(c):
                near = max((len(c[2] & o[2]) / len(c[2] | o[2]) if c[2] and o[2] else 0.0 for o in out), default=0.0)
                return round(c[1] if not out else 0.7 * c[1] - 0.3 * near, 9)
            best = max(left, key=value)
            left.remove(best)
            out.append(best)
        assert [got[q][k] for k in range(5)] == [o[0] for o in out]


def test_post_processing_skips_unknown_steps(spark):
    told = []
    hits = rerank.rerank_none(spark.createDataFrame(FIVE, HITS)).drop("rank")
    out = rerank.post_process(hits, Config(post_processing=("dedupe", "nonsense", "relevance_filter", "mmr")), told.append)
    assert out.count() == 1 and "nonsense" in told[0]


def test_second_round_adds_unseen_texts_only(spark):
    first = spark.createDataFrame([(1, "a", 0.1, 0, "x")], "query_id int, id string, score double, pos int, text string")
    second = spark.createDataFrame([(1, "b", 0.9, 0, "x"), (1, "c", 0.3, 1, "y"), (1, "d", 0.8, 2, "y"), (1, "e", 0.8, 3, "")], first.schema)
    got = [(r.id, r["round"], r.pos) for r in rounds.merge_round(first, second).orderBy("pos").collect()]
    assert got == [("a", 1, 0), ("c", 2, 1)]


def test_corrective_rounds_end_when_sufficient(spark):
    first = spark.createDataFrame([(1, "a", "D", "C", "S", "1", 0.5, 0, "x", 0, 1), (2, "b", "D", "C", "S", "1", 0.5, 0, "y", 0, 1)], "query_id int, id string, doc_name string, chapter string, section string, subsection_id string, score double, pos int, text string, variant_no int, rank int")
    contexts, asked = [], []

    def analyse(ctx):
        contexts.extend(r.context for r in ctx.orderBy("query_id").collect())
        return ctx.select("query_id", F.when(F.col("query_id") == 1, False).alias("sufficient"), F.when(F.col("query_id") == 1, F.array(F.lit("more"))).alias("followup_queries"))

    def strategy(q):  # two variants of every follow-up
        return q.select("query_id", F.posexplode(F.array("query", F.concat(F.lit("explain "), "query"))).alias("variant_no", "variant_query"))

    def retrieve(v):
        asked.extend((r.query_id, r.variant_no, r.variant_query) for r in v.orderBy("variant_no").collect())
        text = F.concat(F.lit("new "), F.col("variant_no").cast("string"))
        return v.select("query_id", text.alias("id"), F.lit("D").alias("doc_name"), F.lit("C").alias("chapter"), F.lit("S").alias("section"), F.lit("2").alias("subsection_id"), F.lit(0.4).alias("score"), F.col("variant_no").alias("pos"), text.alias("text"), "variant_no", F.lit(1).alias("rank"))

    out, raw, gaps = rounds.corrective_rounds(first, first, analyse, strategy, retrieve, 2)
    assert contexts[0] == "[1] D | S | 1\nx"
    assert asked == [(1, 1, "more"), (1, 2, "explain more"), (1, 3, "more"), (1, 4, "explain more")]
    assert sorted((r.query_id, r.id, r["round"]) for r in out.collect()) == [(1, "a", 1), (1, "new 1", 2), (1, "new 2", 2), (1, "new 3", 3), (1, "new 4", 3), (2, "b", 1)] and gaps.count() == 2
    assert sorted(r.variant_no for r in raw.where("query_id = 1").collect()) == [0, 1, 2, 3, 4]
    settled = rounds.settle_gaps(spark.createDataFrame([(1, False, []), (2, None, None), (3, False, ["q"])], "query_id int, sufficient boolean, followup_queries array<string>"))
    assert [r.sufficient for r in settled.orderBy("query_id").collect()] == [True, True, False]


def test_context_window(spark):
    hits = spark.createDataFrame([(1, 0, "D", "C", "", "N/A", "long text"), (1, 1, None, "", "S", "1.2", "b")], "query_id int, pos int, doc_name string, chapter string, section string, subsection_id string, text string")
    assert rounds.context_window(hits, 12, 4).first().context == "[Chunk 1] Document: D | Chapter: C\nlong\n\n---\n\n[Chunk 2] Document: Unknown | Section: S | Subsection: 1.2\nb"


def test_vector_search_agrees_with_brute_force(spark, monkeypatch):
    import numpy as np

    from clauseworks.functions import vectors as V

    monkeypatch.setattr(V, "QUERIES_AT_ONCE", 3)
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(300, 4)), 1)
    v[10] = 0
    rows = [(f"i{i:03d}", [float(x) for x in r], "ab"[i % 2] if i % 7 else None) for i, r in enumerate(v)] + [("null", None, "a"), ("short", [1.0], "a"), (None, [1.0] * 4, "a")]
    df = spark.createDataFrame(rows, "id string, vector array<double>, label string").repartition(5)
    q = df.where("id < 'i010'").withColumnRenamed("id", "query_id")
    held = {i: (np.array(x if x and len(x) == 4 else [0.0] * 4), s) for i, x, s in rows if i}

    def best(i, same):
        a, s = held[i]
        scored = sorted((-round(float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), 6) if np.linalg.norm(a) * np.linalg.norm(b) > 0 else 0.0, j) for j, (b, t) in held.items() if not same or (s is not None and s == t))
        return [(j, -c) for c, j in scored[:7]]

    for same in (None, "label"):
        for size in (64 << 20, 4 * 8 * 4):  # in one block and in several
            got = {}
            for r in V.exact_top_k(q, df, 7, same, size).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((r.id, r.score))
            for i in [f"i{n:03d}" for n in range(10)]:
                want = best(i, same)
                assert [j for j, _ in got.get(i, [])] == [j for j, _ in want] and all(abs(x - y) < 2e-6 for (_, x), (_, y) in zip(got.get(i, []), want)), (i, same, size)


def test_levels_use_one_exchange(spark):
    hits = spark.createDataFrame(FIVE, HITS)
    plan = hierarchy.apply_levels(hits, top_k=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Scan") == 1


def test_many_asked_terms_meet_postings_in_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"licence fee {'tower ' * (i % 3)}w{i % 5}") for i in range(40)], "id int, text string")
    q = spark.createDataFrame([(1, "tower licence"), (2, "w3 fee fee")], "query_id int, query string")
    one = {tuple(r) for r in retrieval.keyword_search(q, docs, "id", "text", 5).collect()}
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert {tuple(r) for r in retrieval.keyword_search(q, docs, "id", "text", 5).collect()} == one and one


def test_keyword_search_hands_on_no_pairs_of_queries_and_documents(spark, monkeypatch):
    """Every document has a word of every query: only the best k of a list and task may be ranked, with the formula's result."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    docs = [["common"] * rng.randint(1, 3) + [rng.choice(words) for _ in range(rng.randint(0, 9))] for _ in range(400)]
    asked = [["common", *rng.sample(words, 3)] for _ in range(30)]
    asked[29] = asked[0][::-1]
    df = spark.createDataFrame([(f"d{i:03d}", " ".join(d)) for i, d in enumerate(docs)], "id string, text string").repartition(6)
    seen, rank = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda scored, *rest: (seen.append(scored.count()), rank(scored, *rest))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        rows = retrieval.keyword_search(spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(asked)], "query_id int, query string"), df, "id", "text", 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, q in enumerate(asked):
        best = sorted((-round(s, 6), f"d{j:03d}") for j, s in enumerate(okapi(docs, q)))[:5]
        assert [(-r.score, r.id) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == i] == [(pytest.approx(s, abs=2e-6), d) for s, d in best]
    assert 0 < seen[0] <= 2 * spark.sparkContext.defaultParallelism * 29 * 5 < 30 * 400
