"""The engine's operators over whole test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseworks.functions import text as T
from clauseworks.functions.hashing import fingerprints
from clauseworks.operators import chunking, extract, feedback, hierarchy, index, judge, ledger, rerank, retrieval, rounds
from clauseworks.operators.materialize import written
from clauseworks.schema import Config
from clauseworks.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        def wide(spark: SparkSession, root: str) -> DataFrame:
            """Whole numbers as 64 bits, as SQL counts them."""
            df = f(spark, root)
            return df.select([F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])

        QUERIES[f.__name__] = wide
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- shared inputs ---------------------------------------------------------------------------------------------


def hits(spark: SparkSession, root: str) -> DataFrame:
    """Retrieved results as hits: one row per result, NaN scores null, ids from document, section and subsection."""
    v = table(spark, root, "variant_results")
    part = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    rows = v.select("result_id", F.concat_ws(":", "run_id", "query_no").alias("query_id"), "variant_no", "result_rank", (F.col("variant_no") * 1000 + F.col("result_rank")).alias("pos"), part("doc_name"), part("chapter"), part("section"), part("subsection_id"), number("score"), number("relevance_score"), number("base_score"))
    rows = rows.withColumn("id", F.concat_ws("|", "doc_name", "section", "subsection_id"))
    return index.keep_first(rows, ["query_id", "result_id"], ["pos"])


_HITS = """(SELECT DISTINCT result_id, run_id || ':' || query_no AS query_id, variant_no, result_rank, variant_no * 1000 + result_rank AS pos,
  coalesce(doc_name, '') AS doc_name, coalesce(chapter, '') AS chapter, coalesce(section, '') AS section, coalesce(subsection_id, '') AS subsection_id,
  coalesce(doc_name, '') || '|' || coalesce(section, '') || '|' || coalesce(subsection_id, '') AS id,
  CASE WHEN NOT isnan(score) THEN score END AS score, CASE WHEN NOT isnan(relevance_score) THEN relevance_score END AS relevance_score, CASE WHEN NOT isnan(base_score) THEN base_score END AS base_score
  FROM variant_results)"""

_BEST = f"""(SELECT query_id, id, doc_name, chapter, section, subsection_id, score, first_pos AS pos FROM (
  SELECT *, min(pos) OVER (PARTITION BY query_id, id) AS first_pos, row_number() OVER (PARTITION BY query_id, id ORDER BY coalesce(score, 0) DESC, pos) AS rn FROM {_HITS}) WHERE rn = 1)"""


def best_hits(spark: SparkSession, root: str) -> DataFrame:
    kept = rerank.dedupe(hits(spark, root), text="id", prefer=("score",))
    return kept.select("query_id", "id", "doc_name", "chapter", "section", "subsection_id", "score", "pos")


def provisions(spark: SparkSession, root: str) -> DataFrame:
    return index.one_each(table(spark, root, "subsections"), "record_id", lambda rows: index.keep_first(rows, ["record_id"], ["loaded_at"]))


_PROVISIONS = "(SELECT DISTINCT * FROM subsections)"
_STOP = "['" + "', '".join(T.STOP_WORDS) + "']"
_TOKENS = r"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*'), lambda x: length(x) > 1 AND NOT list_contains(" + _STOP + ", x))"
_BLANK = r"NOT regexp_matches(coalesce({c}, ''), '\S')"


def text_key():
    return F.concat_ws("|", F.coalesce("document_name", F.lit("")), F.coalesce("section", F.lit("")), F.coalesce("subsection_id", F.lit("")))


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(id, text): of the provisions that share a hit's id, the whole text of the smallest record."""
    return provisions(spark, root).groupBy(text_key().alias("id")).agg(F.min_by("subsection_text", "record_id").alias("text"))


_TEXTS = "(SELECT coalesce(document_name, '') || '|' || coalesce(section, '') || '|' || coalesce(subsection_id, '') AS id, arg_min_null(subsection_text, record_id) AS text FROM subsections GROUP BY 1)"
_HITS_TEXT = f"(SELECT h.*, t.text FROM {_HITS} h LEFT JOIN {_TEXTS} t USING (id))"


def text_hits(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.with_texts(hits(spark, root), texts(spark, root))


def questions(spark: SparkSession, root: str) -> DataFrame:
    """Every reference question; different ones of the same number are rows of their own, as in SQL."""
    return table(spark, root, "reference_answers").select(F.col("ref_id").alias("query_id"), F.col("question").alias("query")).distinct()


def some_questions(spark: SparkSession, root: str) -> DataFrame:
    """Every twentieth of them, for the queries whose SQL asks no more."""
    return table(spark, root, "reference_answers").where("ref_id % 20 = 0").select(F.col("ref_id").alias("query_id"), F.col("question").alias("query")).dropDuplicates(["query_id"])


# --- keyword index and search ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {_TOKENS.format(c='text')} AS t FROM documents)")
def tokenize_stats(spark, root):
    t = table(spark, root, "documents").select("doc_id", T.keyword_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_BM25 = f"""WITH docs AS (SELECT record_id AS id, {_TOKENS.format(c='subsection_text')} AS t FROM {_PROVISIONS}),
 stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
 post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY 1, 2),
 raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, stats GROUP BY term),
 terms AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw)"""


@query(_BM25 + " SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_terms(spark, root):
    post = written(index.postings(provisions(spark, root), "record_id", "subsection_text"))
    n, _ = index.corpus_stats(post)
    return index.term_stats(post, n).select("term", "df", F.round("idf", 6).alias("idf"))


@query(_BM25 + f""", asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.format(c='q')}) AS term FROM (SELECT DISTINCT ref_id AS query_id, question AS q FROM reference_answers)) GROUP BY 1, 2),
 scored AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN asked USING (term) JOIN terms USING (term), stats GROUP BY 1, 2)
 SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 30 AND score > 0""")
def bm25_topk(spark, root):
    return retrieval.keyword_search(questions(spark, root), provisions(spark, root), "record_id", "subsection_text", 30)


_KEYWORD_HITS = _BM25 + f""", asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.format(c='q')}) AS term FROM (SELECT DISTINCT ref_id AS query_id, question AS q FROM reference_answers WHERE ref_id % 20 = 0)) GROUP BY 1, 2),
 scored AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN asked USING (term) JOIN terms USING (term), stats GROUP BY 1, 2),
 kw AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 30 AND score > 0)"""


@query(_KEYWORD_HITS.replace(f"SELECT record_id AS id, {_TOKENS.format(c='subsection_text')} AS t FROM {_PROVISIONS}", f"SELECT doc_id AS id, {_TOKENS.format(c='text')} AS t FROM documents") + " SELECT query_id, id, score, rank FROM kw")
def bm25_documents(spark, root):
    """The same questions against all documents."""
    return retrieval.keyword_search(some_questions(spark, root), table(spark, root, "documents"), "doc_id", "text", 30)


# --- vector search ---------------------------------------------------------------------------------------------


def _vectors(spark, root):
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(spark, root):
    return _vectors(spark, root).where("id % 20 = 0").withColumnRenamed("id", "query_id")


_COS = "coalesce(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6), 0)"
_VEC = f"SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0"


def _ranked(sql: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({sql})) WHERE rank <= {k}"


@query(_ranked(_VEC, 30))
def vector_topk(spark, root):
    return retrieval.vector_search(_asked(spark, root), _vectors(spark, root), 30)


@query(_ranked(_VEC + " AND a.label = b.label", 30))
def vector_topk_filtered(spark, root):
    return retrieval.vector_search(_asked(spark, root), _vectors(spark, root), 30, same="label")


# --- fusion, reranking, deduplication --------------------------------------------------------------------------


def _fused(lists: str, k: int) -> str:
    return f"""SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f // 100000, f % 100000, id) AS rank FROM (
      SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank0 + 1)), 8) AS score, min(list_no * 100000 + rank0) AS f FROM ({lists}) WHERE id::VARCHAR <> '' GROUP BY 1, 2)) WHERE rank <= {k}"""


@query(_KEYWORD_HITS + f", vec AS ({_ranked(_VEC, 30)}) " + _fused("SELECT query_id, id, 0 AS list_no, rank - 1 AS rank0 FROM vec UNION ALL SELECT query_id, id, 1, rank - 1 FROM kw", 30))
def hybrid_rrf(spark, root):
    """The vectors stand for provisions of the same number, their queries for questions of the same number."""
    keyword = retrieval.keyword_search(some_questions(spark, root), provisions(spark, root), "record_id", "subsection_text", 30)
    near = retrieval.vector_search(_asked(spark, root), _vectors(spark, root), 30)
    return retrieval.hybrid(near, keyword, 30).select("query_id", "id", "score", "rank")


@query(_fused(f"SELECT query_id, id, variant_no AS list_no, result_rank - 1 AS rank0 FROM {_HITS}", 20))
def rrf_multi(spark, root):
    lists = hits(spark, root).select("query_id", "id", F.col("variant_no").alias("list_no"), (F.col("result_rank") - 1).alias("rank0"))
    return rerank.rerank_lists(lists, 20).select("query_id", "id", F.col("relevance_score").alias("score"), "rank")


@query(f"""SELECT query_id, id, md5(text) AS text_md5, score, first_pos AS pos FROM (SELECT *, min(pos) OVER (PARTITION BY query_id, text) AS first_pos, row_number() OVER (PARTITION BY query_id, text ORDER BY coalesce(score, 0) DESC, pos) AS rn
  FROM {_HITS_TEXT} WHERE regexp_matches(text, '\\S')) WHERE rn = 1""")
def dedupe_keep_best(spark, root):
    kept = rerank.dedupe(text_hits(spark, root), prefer=("score",))
    return kept.select("query_id", "id", F.md5("text").alias("text_md5"), "score", "pos")


@query(f"SELECT query_id, id, coalesce(score, 0) AS relevance_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, pos) AS rank FROM {_BEST}) WHERE rank <= 20")
def rerank_none(spark, root):
    return rerank.rerank_none(best_hits(spark, root)).select("query_id", "id", "relevance_score", "rank")


@query(f"SELECT query_id, id, round(1.0::DOUBLE / (60 + rank), 8) AS relevance_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM {_BEST}) WHERE rank <= 20")
def rerank_rrf_single(spark, root):
    return rerank.rerank_fused(best_hits(spark, root)).select("query_id", "id", "relevance_score", "rank")


@query(f"""SELECT query_id, id, s / 10 AS relevance_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, i) AS rank FROM (
  SELECT *, CASE WHEN length(id) % 7 = 0 THEN 5.0::DOUBLE ELSE (length(id) % 11)::DOUBLE END AS s, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS i FROM {_BEST}) WHERE i < 30 QUALIFY rank <= 20""")
def rerank_score_table(spark, root):
    h = best_hits(spark, root)
    scores = h.where(F.length("id") % 7 != 0).select("query_id", "id", (F.length("id") % 11).cast("double").alias("model_score"))
    return rerank.rerank_scored(h, scores).select("query_id", "id", "relevance_score", "rank")


@query(f"SELECT result_id, relevance_score FROM {_HITS} WHERE coalesce(relevance_score, 0) >= 0.3")
def relevance_filter(spark, root):
    return rerank.relevance_filter(hits(spark, root), 0.3).select("result_id", "relevance_score")


_MMR = f"""WITH RECURSIVE top AS (SELECT query_id, id, rank AS pos, coalesce(score, 0) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, pos) AS rank FROM {_BEST}) WHERE rank <= 20),
 cand AS (SELECT query_id, pos, top.id, rel, list_distinct(regexp_extract_all(lower(coalesce(t.text, '')), '[a-z0-9]+')) AS toks FROM top LEFT JOIN {_TEXTS} t ON t.id = top.id),
 near AS (SELECT a.query_id, a.pos, max(a.id) AS id, max(a.rel) AS rel, map(list(b.pos ORDER BY b.pos), list(CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0 ELSE len(list_intersect(a.toks, b.toks))::DOUBLE / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) END ORDER BY b.pos)) AS j
   FROM cand a JOIN cand b USING (query_id) GROUP BY 1, 2),
 pick AS (
  SELECT query_id, 0 AS step, [arg_max(pos, (round(rel, 9), -pos))] AS picked FROM near GROUP BY query_id
  UNION ALL
  SELECT query_id, any_value(step) + 1, list_append(any_value(picked), arg_max(pos, (worth, -pos))) FROM (
   SELECT p.query_id, p.step, p.picked, n.pos, round(0.7::DOUBLE * n.rel - (1 - 0.7::DOUBLE) * list_max(list_transform(p.picked, lambda x: n.j[x])), 9) AS worth FROM pick p JOIN near n ON n.query_id = p.query_id AND NOT list_contains(p.picked, n.pos) WHERE p.step < 9) GROUP BY query_id)
 SELECT p.query_id, n.id, p.step::BIGINT AS pick FROM pick p JOIN near n ON n.query_id = p.query_id AND n.pos = p.picked[-1]"""


@query(_MMR)
def mmr_select(spark, root):
    top = rerank.rerank_none(best_hits(spark, root)).withColumn("pos", F.col("rank"))
    return rerank.diversify(retrieval.with_texts(top, texts(spark, root)), 0.7, 10)


@query(f"SELECT result_id, id, md5(text) AS text_md5, length(text) AS chars FROM {_HITS_TEXT}")
def enrich_left_join(spark, root):
    return text_hits(spark, root).select("result_id", "id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


@query(f"SELECT relevance, count(*) AS n FROM (SELECT CASE WHEN base_score >= 0.65 THEN 'high' WHEN base_score <= 0.3 THEN 'low' ELSE 'medium' END AS relevance FROM {_HITS}) GROUP BY 1")
def relevance_classes(spark, root):
    """A hit without a score is neither high nor low."""
    return hits(spark, root).groupBy(hierarchy.relevance_class(F.col("base_score")).alias("relevance")).agg(F.count("*").alias("n"))


# --- hierarchy -------------------------------------------------------------------------------------------------

_GROUPS = "SELECT query_id, {keys}, round(max({s}) + 0.25 * avg({s}), 9) AS group_score, min(pos) AS f FROM {src} GROUP BY query_id, {keys}"


@query(f"SELECT query_id, doc_name, chapter, section, group_score, row_number() OVER (PARTITION BY query_id ORDER BY group_score DESC, f) - 1 AS group_rank FROM ({_GROUPS.format(keys='doc_name, chapter, section', s='coalesce(score, 0)', src=_BEST)})")
def group_rank(spark, root):
    return hierarchy.group_scores(best_hits(spark, root), "section", "score")


def _level(src: str, keys: str, keep: int, name: str) -> str:
    groups = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_score DESC, f) - 1 AS r FROM ({_GROUPS.format(keys=keys, s='base_score', src=src)})) WHERE r < {keep}"
    return f"(SELECT h.* REPLACE (h.score + 0.1::DOUBLE / (1 + g.r) AS score), g.r AS hier_{name}_rank FROM {src} h JOIN ({groups}) g USING (query_id, {keys}))"


_L0 = f"(SELECT query_id, id, doc_name, chapter, section, coalesce(score, 0) AS base_score, coalesce(score, 0) AS score, pos FROM {_BEST})"
_L3 = _level("l2", "doc_name, chapter, section", 5, "section")


@query(f"""WITH l0 AS {_L0}, l1 AS {_level('l0', 'doc_name', 3, 'doc_name')}, l2 AS {_level('l1', 'doc_name, chapter', 4, 'chapter')}, l3 AS {_L3}
SELECT query_id, id, round(score, 6) AS score, hier_doc_name_rank, hier_chapter_rank, hier_section_rank, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, pos, id) AS rank FROM l3) WHERE rank <= 30""")
def level_filter(spark, root):
    out = hierarchy.apply_levels(best_hits(spark, root), top_k=30)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "hier_doc_name_rank", "hier_chapter_rank", "hier_section_rank", "rank")


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"doc_name": F.concat(F.lit("D"), F.col("label") % 3), "chapter": F.concat(F.lit("C"), F.col("label")), "section": F.concat(F.lit("S"), F.col("id") % 4)})


def _pool(spark, root, k):
    top = retrieval.vector_search(_asked(spark, root), _vectors(spark, root), k)
    return _placed(top.join(_vectors(spark, root).select("id", "label"), "id")).withColumn("pos", F.col("rank"))


_PLACED = "'D' || (b.label % 3) AS doc_name, 'C' || b.label AS chapter, 'S' || (b.vec_id % 4) AS section"
_POOL = f"(SELECT query_id, id, score, {_PLACED}, rank AS pos FROM ({_ranked(_VEC, 10)}) JOIN embeddings b ON b.vec_id = id)"


@query(f"""WITH pool AS {_POOL},
 best AS (SELECT query_id, section, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_score DESC, f) - 1 AS r FROM ({_GROUPS.format(keys='doc_name, chapter, section', s='score', src='pool')})) WHERE r < 5),
 found AS (SELECT * FROM (SELECT query_id, r, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY query_id, r ORDER BY {_COS} DESC, b.vec_id) AS k
   FROM best JOIN embeddings b ON 'S' || (b.vec_id % 4) = best.section JOIN embeddings a ON a.vec_id = best.query_id) WHERE k <= 5),
 fresh AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY r, k) AS n FROM found ANTI JOIN pool USING (query_id, id)) WHERE n = 1)
 SELECT query_id, id, score, false AS sibling_expanded FROM pool UNION ALL SELECT query_id, id, score, true FROM fresh""")
def sibling_expand(spark, root):
    candidates = _placed(_vectors(spark, root)).drop("label")
    out = hierarchy.siblings(_pool(spark, root, 10).drop("label"), candidates, _asked(spark, root).select("query_id", "vector"))
    return out.select("query_id", "id", "score", "sibling_expanded")


_NEAR = Config(high=0.40, low=0.15, moderate=0.10)


@query(f"""WITH top AS ({_ranked(_VEC, 30)}),
 med AS (SELECT *, CASE WHEN score >= 0.40 THEN 'high' WHEN score <= 0.15 THEN 'low' ELSE 'medium' END AS relevance FROM top),
 near AS (SELECT m.query_id, m.id, d.side, d.hop, d.side * d.hop + m.id AS near_id, {_COS.replace('a.embedding', 'q.embedding').replace('b.embedding', 'v.embedding')} AS near, v.vec_id IS NOT NULL AS there
   FROM med m, (VALUES (-1, 1), (-1, 2), (1, 1), (1, 2)) d(side, hop) JOIN embeddings q ON q.vec_id = m.query_id LEFT JOIN embeddings v ON v.vec_id = m.id + d.side * d.hop AND v.vec_id // 25 = m.id // 25 WHERE m.relevance = 'medium'),
 ok AS (SELECT * FROM near n WHERE there AND near >= 0.10 AND (hop = 1 OR EXISTS (SELECT 1 FROM near p WHERE p.query_id = n.query_id AND p.id = n.id AND p.side = n.side AND p.hop = 1 AND p.there AND p.near >= 0.10)))
 SELECT m.query_id, m.id, m.relevance, array_to_string(list_transform(list_sort(list_append(coalesce(o.ids, []), m.id)), lambda x: 't' || x), chr(10) || chr(10)) AS text
 FROM med m LEFT JOIN (SELECT query_id, id, list(near_id) AS ids FROM ok GROUP BY 1, 2) o USING (query_id, id)""")
def neighbor_expand(spark, root):
    v = _vectors(spark, root)
    linked = chunking.assign_neighbors(v.select("id", F.floor(F.col("id") / 25).cast("string").alias("doc")), "doc", "id", "id")  # documents of 25 chunks
    top = written(retrieval.vector_search(_asked(spark, root), v, 30).withColumnRenamed("score", "base_score"))
    said = v.select("id", F.concat(F.lit("t"), F.col("id")).alias("text"))
    out = hierarchy.neighbours(top.join(linked.select("id", "prev_ids", "next_ids"), "id").join(said, "id"), v, said, _asked(spark, root).select("query_id", "vector"), _NEAR)
    return out.select("query_id", "id", "relevance", "text")


def _near(src: str) -> str:
    """CTEs `med`, `near`, `ok` over rows (query_id, id, score): relevance, and the adjoining chunks, of documents of 25, that pass."""
    return f"""med AS (SELECT *, CASE WHEN score >= 0.40 THEN 'high' WHEN score <= 0.15 THEN 'low' ELSE 'medium' END AS relevance FROM {src}),
 near AS (SELECT m.query_id, m.id, d.side, d.hop, d.side * d.hop + m.id AS near_id, {_COS.replace('a.embedding', 'q.embedding').replace('b.embedding', 'v.embedding')} AS near, v.vec_id IS NOT NULL AS there
   FROM med m, (VALUES (-1, 1), (-1, 2), (1, 1), (1, 2)) d(side, hop) JOIN embeddings q ON q.vec_id = m.query_id LEFT JOIN embeddings v ON v.vec_id = m.id + d.side * d.hop AND v.vec_id // 25 = m.id // 25 WHERE m.relevance = 'medium'),
 ok AS (SELECT * FROM near n WHERE there AND near >= 0.10 AND (hop = 1 OR EXISTS (SELECT 1 FROM near p WHERE p.query_id = n.query_id AND p.id = n.id AND p.side = n.side AND p.hop = 1 AND p.there AND p.near >= 0.10)))"""


@query(f"""WITH pool AS {_POOL},
 best AS (SELECT query_id, section, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_score DESC, f) - 1 AS r FROM ({_GROUPS.format(keys='doc_name, chapter, section', s='score', src='pool')})) WHERE r < 5),
 found AS (SELECT * FROM (SELECT query_id, r, b.vec_id AS id, {_COS} AS score, {_PLACED}, row_number() OVER (PARTITION BY query_id, r ORDER BY {_COS} DESC, b.vec_id) AS k
   FROM best JOIN embeddings b ON 'S' || (b.vec_id % 4) = best.section JOIN embeddings a ON a.vec_id = best.query_id) WHERE k <= 5),
 fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY r, k) AS n FROM found ANTI JOIN pool USING (query_id, id)) WHERE n = 1),
 wide AS (SELECT query_id, id, score, doc_name, chapter, section, pos FROM pool UNION ALL
   SELECT query_id, id, score, doc_name, chapter, section, last + row_number() OVER (PARTITION BY query_id ORDER BY r, k) FROM fresh JOIN (SELECT query_id, max(pos) AS last FROM pool GROUP BY 1) USING (query_id)),
 l0 AS (SELECT query_id, id, doc_name, chapter, section, score AS base_score, score, pos FROM wide), l1 AS {_level('l0', 'doc_name', 3, 'doc_name')}, l2 AS {_level('l1', 'doc_name, chapter', 4, 'chapter')}, l3 AS {_L3},
 kept AS (SELECT query_id, id, base_score AS score, round(score, 6) AS boosted, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, pos, id) AS rank FROM l3) WHERE rank <= 12),
 {_near('kept')}
 SELECT m.query_id, m.id, m.boosted AS score, m.rank, m.relevance, array_to_string(list_transform(list_sort(list_append(coalesce(o.ids, []), m.id)), lambda x: 't' || x), chr(10) || chr(10)) AS text
 FROM med m LEFT JOIN (SELECT query_id, id, list(near_id) AS ids FROM ok GROUP BY 1, 2) o USING (query_id, id)""")
def hierarchical_search(spark, root):
    """The whole hierarchical retriever: pool, siblings, levels, cut, neighbours."""
    v = _vectors(spark, root)
    linked = chunking.assign_neighbors(v.select("id", F.floor(F.col("id") / 25).cast("string").alias("doc")), "doc", "id", "id").select("id", "prev_ids", "next_ids")
    said = v.select("id", F.concat(F.lit("t"), F.col("id")).alias("text"))
    candidates = _placed(v).drop("label").join(linked, "id").join(said, "id")
    pool = _pool(spark, root, 10).drop("label", "rank").join(linked, "id").join(said, "id")
    config = Config(top_k=12, high=0.40, low=0.15, moderate=0.10)
    out = hierarchy.hierarchical_search(pool, candidates, said, _asked(spark, root).select("query_id", "vector"), config)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank", "relevance", "text")


# --- rounds and contexts ---------------------------------------------------------------------------------------


@query(f"""WITH h AS (SELECT * FROM {_HITS_TEXT}) SELECT query_id, id, score, round FROM (
  SELECT query_id, id, score, 1 AS round FROM h WHERE variant_no = 1 UNION ALL
  SELECT query_id, id, score, 2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY pos) AS rn FROM h s WHERE variant_no > 1 AND regexp_matches(text, '\\S') AND NOT EXISTS (SELECT 1 FROM h f WHERE f.variant_no = 1 AND f.query_id = s.query_id AND f.text = s.text)) WHERE rn = 1)""")
def two_call_merge(spark, root):
    h = text_hits(spark, root)
    return rounds.merge_round(h.where("variant_no = 1"), h.where("variant_no > 1")).select("query_id", "id", "score", "round")


_FIRST_12 = f"(SELECT b.*, coalesce(t.text, '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS i FROM {_BEST}) b LEFT JOIN {_TEXTS} t ON t.id = b.id WHERE i <= 12)"
_RULE = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@query(f"""SELECT query_id, count(*) AS n_chunks, md5(string_agg('[Chunk ' || i || '] Document: ' || doc_name || CASE WHEN chapter <> '' THEN ' | Chapter: ' || chapter ELSE '' END || CASE WHEN section <> '' THEN ' | Section: ' || section ELSE '' END
  || CASE WHEN subsection_id NOT IN ('', 'N/A') THEN ' | Subsection: ' || subsection_id ELSE '' END || chr(10) || text, {_RULE} ORDER BY i)) AS context_md5 FROM {_FIRST_12} GROUP BY query_id""")
def context_window(spark, root):
    """Contexts of answers: whole texts under full headers."""
    w = rounds.context_window(retrieval.with_texts(best_hits(spark, root), texts(spark, root)), longest=None)
    return w.select("query_id", "n_chunks", F.md5("context").alias("context_md5"))


@query(f"SELECT query_id, count(*) AS n_chunks, md5(string_agg('[' || i || '] ' || doc_name || ' | ' || section || ' | ' || subsection_id || chr(10) || substr(text, 1, 600), {_RULE} ORDER BY i)) AS context_md5 FROM {_FIRST_12} GROUP BY query_id")
def gap_context(spark, root):
    """Contexts of gap analysis: texts cut to 600 characters under short headers."""
    w = rounds.context_window(retrieval.with_texts(best_hits(spark, root), texts(spark, root)), gaps=True)
    return w.select("query_id", "n_chunks", F.md5("context").alias("context_md5"))


@query(f"""SELECT query_id, count(*) AS results, count(DISTINCT variant_no) AS variants, count(DISTINCT id) AS distinct_results, round(max(coalesce(score, 0)), 6) AS best FROM {_HITS} GROUP BY 1""")
def trace_overview(spark, root):
    from clauseworks.plans.pipeline import overview, traces

    return overview(traces(hits(spark, root)))


# --- extraction, sequencing, chunks ----------------------------------------------------------------------------


def page_items(spark, root):
    """Every record as an item of its page; those of re-issued documents, which share name and place, follow one another by record."""
    p = provisions(spark, root).withColumn("doc", F.coalesce("document_name", F.lit("")))
    kind = F.element_at(F.array(*map(F.lit, ("chapter_header", "section_header", "new_subsection", "continuation", "new_subsection", "continuation"))), (F.pmod("seq", F.lit(6)) + 1).cast("int"))
    item = F.row_number().over(Window.partitionBy("doc", "seq").orderBy("record_id"))
    content = F.when(F.pmod("seq", F.lit(6)) == 0, F.col("chapter")).when(F.pmod("seq", F.lit(6)) == 1, F.col("section")).otherwise(F.col("subsection_text"))
    return p.select("doc", F.col("seq").alias("page"), item.alias("item"), kind.alias("type"), content.alias("content"), F.element_at(F.split("subsection_id", r"\."), 1).alias("id"))


_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _stripped(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


_FOLD = f"""WITH items AS (SELECT coalesce(document_name, '') AS doc, seq AS page, seq::BIGINT * 1000000 + row_number() OVER (PARTITION BY coalesce(document_name, ''), seq ORDER BY record_id) AS ord, (seq % 6 + 6) % 6 AS m,
   coalesce(CASE (seq % 6 + 6) % 6 WHEN 0 THEN chapter WHEN 1 THEN section ELSE subsection_text END, '') AS content, split_part(subsection_id, '.', 1) AS id FROM {_PROVISIONS}),
 run AS (SELECT *, coalesce(last_value(CASE WHEN m = 0 THEN content END IGNORE NULLS) OVER w, 'Preamble') AS ch, coalesce(last_value(CASE WHEN m = 0 THEN 'General' WHEN m = 1 THEN content END IGNORE NULLS) OVER w, 'General') AS se,
   sum(CASE WHEN m IN (3, 5) THEN 0 ELSE 1 END) OVER w AS g FROM items WINDOW w AS (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING)),
 grp AS (SELECT doc, g, min(ord) AS f, arg_min(ch, ord) AS chapter, arg_min(se, ord) AS section, arg_min(CASE WHEN m IN (3, 5) THEN 'Introduction/Continuation' WHEN m IN (2, 4) THEN coalesce(nullif(id, ''), 'N/A') ELSE 'N/A' END, ord) AS sid,
   string_agg(CASE WHEN m IN (0, 1) THEN '' ELSE content END, ' ' ORDER BY ord) AS txt, list_sort(list_distinct(list(page))) AS pages FROM run GROUP BY doc, g),
 isl AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY f) AS isl FROM (SELECT *, CASE WHEN sid NOT IN ('', 'N/A') AND lag(sid) OVER (PARTITION BY doc ORDER BY f) = sid THEN 0 ELSE 1 END AS new FROM grp WHERE {_stripped('txt')} <> ''))
 SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY min(f)) - 1 AS seq, arg_min(chapter, f) AS chapter, arg_min(section, f) AS section, any_value(sid) AS subsection_id, md5({_stripped("string_agg(" + _stripped('txt') + ", ' ' ORDER BY f)")}) AS text_md5, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages
 FROM isl GROUP BY doc, isl"""


@query(_FOLD)
def extract_fold(spark, root):
    out = extract.fold_items(page_items(spark, root))
    return out.select("doc", "seq", "chapter", "section", "subsection_id", F.md5("subsection_text").alias("text_md5"), F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("pages"))


@query("""SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY f) - 1 AS seq, subsection_id, n FROM (
  SELECT doc, isl, min(event_id) AS f, any_value(event_type) AS subsection_id, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY event_id) AS isl FROM (SELECT user_id AS doc, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY doc, isl)""")
def merge_adjacent(spark, root):
    e = table(spark, root, "events").select(F.col("user_id").alias("doc"), "event_id", F.col("event_type").alias("subsection_id"), F.lit("").alias("chapter"), F.lit("").alias("section"), F.lit("x").alias("subsection_text"), F.array(F.col("event_id")).alias("page_numbers"))
    out = extract.merge_adjacent(e, "doc", "event_id")
    return out.select("doc", "seq", "subsection_id", F.size("page_numbers").cast("long").alias("n"))


@query(f"""SELECT record_id, seq, array_to_string(list_filter([p1, p2], lambda x: x IS NOT NULL), ',') AS prev_ids, array_to_string(list_filter([n1, n2], lambda x: x IS NOT NULL), ',') AS next_ids FROM (
  SELECT record_id, (row_number() OVER w - 1)::BIGINT AS seq, lag(record_id, 1) OVER w AS p1, lag(record_id, 2) OVER w AS p2, lead(record_id, 1) OVER w AS n1, lead(record_id, 2) OVER w AS n2 FROM (SELECT DISTINCT record_id, document_name, seq FROM subsections)
  WINDOW w AS (PARTITION BY coalesce(document_name, '') ORDER BY seq, record_id))""")
def assign_neighbors(spark, root):
    p = provisions(spark, root).select("record_id", "document_name", F.col("seq").alias("place"))
    out = chunking.assign_neighbors(p, "document_name", "record_id", "place", "record_id")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("record_id", "seq", joined("prev_ids"), joined("next_ids"))


@query(f"""SELECT coalesce(document_name, 'Unknown Document') AS doc_name, seq, md5('Document: ' || coalesce(document_summary, '') || chr(10) || 'Chapter: ' || coalesce(chapter, '') || chr(10) || 'Section: ' || coalesce(section, '') || chr(10) || subsection_text) AS text_md5,
  coalesce(array_to_string(page_numbers, ', '), '') AS page_numbers FROM {_PROVISIONS} WHERE regexp_matches(subsection_text, '\\S') AND length(subsection_text) <= 2048""")
def chunk_embed_text(spark, root):
    c = chunking.chunk(provisions(spark, root)).where(~F.col("is_split"))
    return c.select("doc_name", "seq", F.md5("text").alias("text_md5"), "page_numbers")


@query()
def chunk_split(spark, root):
    """No SQL: a recursive splitter; tested against its guarantees."""
    c = chunking.chunk(provisions(spark, root).where("length(subsection_text) > 2048"))
    return c.select("id", "doc_name", "seq", "chunk_index", "total_chunks", F.length("subsection_text").alias("chars"))


@query(f"SELECT document_name, array_to_string(list_sort(list_distinct(flatten(list(coalesce(page_numbers, []))))), ',') AS pages, count(*) AS records FROM {_PROVISIONS} GROUP BY 1")
def page_union(spark, root):
    pages = extract.page_union(F.coalesce("page_numbers", F.array().cast("array<int>")))
    return provisions(spark, root).groupBy("document_name").agg(F.array_join(F.transform(pages, lambda x: x.cast("string")), ",").alias("pages"), F.count("*").alias("records"))


_PRINT = "sha256(string_agg(sha256(to_json({'document_summary': document_summary, 'section': section, 'subsection_id': subsection_id, 'subsection_text': subsection_text})), chr(10) ORDER BY record_id))"


@query(f"""WITH cur AS (SELECT coalesce(document_name, '') AS document, count(*)::BIGINT AS n, {_PRINT} AS fp FROM {_PROVISIONS} GROUP BY 1)
 SELECT document, n AS chunk_count, fp AS chunk_fingerprint, CASE length(document) % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'replace' ELSE 'new' END AS state FROM cur""")
def ingest_ledger_skip(spark, root):
    """Fingerprints of all texts; of the ledger's documents some are as they were, some had another text, some are new."""
    cur = written(ledger_rows(spark, root))
    old = F.when(F.length("document") % 3 == 1, F.sha2(F.concat("chunk_fingerprint", F.lit("another text")), 256)).otherwise(F.col("chunk_fingerprint"))
    known = cur.where(F.length("document") % 3 < 2).withColumn("chunk_fingerprint", old)
    return ledger.pending(cur, known).select("document", "chunk_count", "chunk_fingerprint", "state")


def ledger_rows(spark, root):
    p = provisions(spark, root).withColumn("document", F.coalesce("document_name", F.lit("")))
    marks = fingerprints(p, "document", "record_id", "document_summary", "section", "subsection_id", "subsection_text")
    return marks.select(F.lit("i").alias("index_name"), F.lit("n").alias("namespace"), "document", "chunk_fingerprint", "chunk_count", F.lit("e").alias("embedder"), F.lit("m").alias("model"), F.lit(64).alias("dimension"))


@query("SELECT doc_id::VARCHAR AS source_file, CASE doc_id % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' WHEN 2 THEN 'new' ELSE 'missing' END AS state FROM documents")
def sync_classify(spark, root):
    d = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("source_file"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 4).alias("k"))
    tracked = d.where("k <> 2").withColumn("sha256", F.when(F.col("k") == 1, F.lit("old")).otherwise(F.col("sha256")))
    return ledger.sync_states(d.where("k <> 3"), tracked)


# --- feedback --------------------------------------------------------------------------------------------------

_GRADE = "CASE WHEN {c} BETWEEN 1 AND 5 THEN {c}::BIGINT END AS {c}"
_LATEST = f"""(SELECT id, response_id, rater_id, {', '.join(_GRADE.format(c=c) for c in feedback.CRITERIA)}, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY response_id, rater_id ORDER BY updated_at DESC NULLS LAST, id DESC) AS rn FROM ratings) WHERE rn = 1)"""
_RESPONSES = "(SELECT DISTINCT id, question, retriever FROM chat_responses)"


def _latest(spark, root):
    return feedback.latest_ratings(table(spark, root, "ratings"))


@query(f"SELECT id, response_id, rater_id, {', '.join(feedback.CRITERIA)} FROM {_LATEST}")
def upsert_latest(spark, root):
    return _latest(spark, root).select("id", "response_id", "rater_id", *feedback.CRITERIA)


@query(f"SELECT r.responses, g.ratings, g.rated, CASE WHEN r.responses > 0 THEN round(100.0::DOUBLE * g.rated / r.responses, 1) ELSE 0 END AS coverage FROM (SELECT count(DISTINCT id) AS responses FROM chat_responses) r, (SELECT count(*) AS ratings, count(DISTINCT response_id) AS rated FROM {_LATEST}) g")
def admin_totals(spark, root):
    return feedback.totals(table(spark, root, "chat_responses"), _latest(spark, root))


@query(f"""WITH l AS (UNPIVOT (SELECT id, {', '.join(feedback.CRITERIA)} FROM {_LATEST}) ON {', '.join(feedback.CRITERIA)} INTO NAME criterion VALUE v)
 SELECT c.criterion, g.grade::BIGINT AS grade, count(l.v) AS n, any_value(m.mean) AS mean FROM (SELECT DISTINCT criterion FROM l) c CROSS JOIN range(1, 6) g(grade) LEFT JOIN l ON l.criterion = c.criterion AND l.v = g.grade
 JOIN (SELECT criterion, round(avg(v), 2) AS mean FROM l GROUP BY 1) m ON m.criterion = c.criterion GROUP BY 1, 2""")
def criterion_histogram(spark, root):
    return feedback.criterion_stats(_latest(spark, root))


@query(f"SELECT r.retriever, count(DISTINCT r.id) AS responses, count(g.id) AS ratings, {', '.join(f'round(coalesce(avg(g.{c}), 0), 2) AS {c}' for c in feedback.CRITERIA)} FROM {_RESPONSES} r LEFT JOIN {_LATEST} g ON g.response_id = r.id GROUP BY 1")
def retriever_breakdown(spark, root):
    return feedback.by_retriever(table(spark, root, "chat_responses"), _latest(spark, root))


@query(f"SELECT g.id, g.response_id, r.question, g.updated_at FROM {_LATEST} g JOIN {_RESPONSES} r ON r.id = g.response_id ORDER BY g.updated_at DESC NULLS LAST, g.id LIMIT 50")
def recent_feedback(spark, root):
    return feedback.recent(table(spark, root, "chat_responses"), _latest(spark, root), 50).select("id", "response_id", "question", "updated_at")


@query(r"SELECT DISTINCT id, length(regexp_replace(regexp_replace(coalesce(question, ''), '^\s+', ''), '\s+$', ''))::BIGINT AS chars FROM chat_responses WHERE length(regexp_replace(regexp_replace(coalesce(question, ''), '^\s+', ''), '\s+$', '')) BETWEEN 2 AND 5000 AND length(session_id) BETWEEN 1 AND 64")
def valid_requests(spark, root):
    rows = feedback.valid_requests(table(spark, root, "chat_responses"))
    return rows.select("id", F.length(T.strip(F.coalesce("question", F.lit("")))).alias("chars")).distinct()


# --- evaluation ------------------------------------------------------------------------------------------------


def judged(spark, root):
    """Ratings as judge rows: an experiment per retriever, grades as metrics, 0 where there is none."""
    r = table(spark, root, "chat_responses").select(F.col("id").alias("response_id"), F.col("retriever").alias("experiment")).distinct()
    g = _latest(spark, root).join(r, "response_id")
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    rows = g.select("id", "experiment", zero("retrieval_relevance", "ctx_precision"), zero("completeness", "ctx_sufficiency"), zero("correctness", "faithfulness"), zero("correctness", "correctness"), F.lit(0).alias("answer_relevance"))
    return judge.composites(rows)


def _mean2(*cols: str) -> str:
    xs = f"list_filter([{', '.join(f'{c}::DOUBLE' for c in cols)}], lambda x: x > 0)"
    return f"CASE WHEN len({xs}) > 0 THEN round(list_sum({xs}) / len({xs}), 2) ELSE 0 END"


_JUDGED = f"""(SELECT *, {_mean2('retrieval_score', 'generation_score')} AS overall_score FROM (SELECT *, {_mean2('ctx_precision', 'ctx_sufficiency')} AS retrieval_score, {_mean2('faithfulness', 'correctness', 'answer_relevance')} AS generation_score FROM (
  SELECT g.id, r.retriever AS experiment, coalesce(g.retrieval_relevance, 0) AS ctx_precision, coalesce(g.completeness, 0) AS ctx_sufficiency, coalesce(g.correctness, 0) AS faithfulness, coalesce(g.correctness, 0) AS correctness, 0 AS answer_relevance FROM {_LATEST} g JOIN {_RESPONSES} r ON r.id = g.response_id)))"""
_LONG = f"(SELECT * FROM (UNPIVOT (SELECT experiment, {', '.join(f'{m}::DOUBLE AS {m}' for m in judge.METRICS)} FROM {_JUDGED}) ON {', '.join(judge.METRICS)} INTO NAME metric VALUE v) WHERE v > 0)"
_SUMMARY = f"(SELECT experiment, metric, round(avg(v), 3) AS mean, round(stddev_pop(v), 3) AS std, round(min(v), 3) AS min, round(max(v), 3) AS max, count(*) AS n FROM {_LONG} GROUP BY 1, 2)"


@query(f"SELECT id, retrieval_score, generation_score, overall_score FROM {_JUDGED}")
def composite_scores(spark, root):
    return judged(spark, root).select("id", *judge.COMPOSITES)


@query(f"SELECT * FROM {_SUMMARY}")
def judge_summary(spark, root):
    return judge.summary(judged(spark, root), judge.METRICS, "experiment")


@query(f"""SELECT *, row_number() OVER (ORDER BY coalesce(overall_score, 0) DESC, experiment) AS place FROM (SELECT experiment, count(*) AS n_queries, {', '.join(f'round(avg(CASE WHEN {m} > 0 THEN {m}::DOUBLE END), 3) AS {m}' for m in judge.METRICS)} FROM {_JUDGED} GROUP BY 1)""")
def leaderboard(spark, root):
    return judge.leaderboard(judged(spark, root))


@query(f"""SELECT label_a, label_b, metric, mean_a, mean_b, delta, CASE WHEN abs(delta) < 0.05 OR mean_a = 0 OR mean_b = 0 THEN 'tie' WHEN delta > 0 THEN label_b ELSE label_a END AS winner FROM (
  SELECT x.experiment AS label_a, y.experiment AS label_b, x.metric, x.mean AS mean_a, y.mean AS mean_b, round(y.mean - x.mean, 3) AS delta FROM {_SUMMARY} x JOIN {_SUMMARY} y ON x.metric = y.metric AND x.experiment < y.experiment)""")
def compare_experiments(spark, root):
    return judge.compare_all(judge.summary(judged(spark, root), judge.METRICS, "experiment"))


@query("""SELECT id AS pair_id, CASE WHEN w1 IS NULL OR w2 IS NULL THEN 'JUDGE_ERROR' WHEN w1 = w2 THEN w1 ELSE 'tie' END AS winner, CASE WHEN w1 IS NULL OR w2 IS NULL THEN 0 WHEN w1 = w2 THEN round((c1 + c2) / 2.0::DOUBLE, 2) ELSE 1 END AS confidence,
  coalesce(w1 IS NOT NULL AND w2 IS NOT NULL AND w1 <> w2, false) AS position_bias FROM (
  SELECT DISTINCT id, CASE WHEN latency_ms IS NULL THEN NULL WHEN latency_ms % 3 = 0 THEN 'A' WHEN latency_ms % 3 = 1 THEN 'B' ELSE 'tie' END AS w1, CASE latency_ms % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'tie' WHEN 3 THEN 'A' END AS w2, latency_ms % 7 + 1 AS c1, latency_ms % 4 + 1 AS c2 FROM chat_responses)""")
def pairwise_merge(spark, root):
    r = table(spark, root, "chat_responses").select(F.col("id").alias("pair_id"), F.col("latency_ms").alias("l")).distinct()
    straight = r.select("pair_id", F.lit(False).alias("swapped"), F.when(F.col("l") % 3 == 0, "A").when(F.col("l") % 3 == 1, "B").when(F.col("l") % 3 == 2, "tie").alias("winner"), (F.col("l") % 7 + 1).alias("confidence"))
    swapped = r.select("pair_id", F.lit(True).alias("swapped"), F.when(F.col("l") % 5 == 0, "A").when(F.col("l") % 5 == 1, "B").when(F.col("l") % 5 == 2, "tie").when(F.col("l") % 5 == 3, "B").alias("winner"), (F.col("l") % 4 + 1).alias("confidence"))
    return judge.merge_swapped(straight.unionByName(swapped))


_AXES = (["voyage", "openai"], ["vector", "bm25", "hybrid", "hierarchical"], ["none", "rrf", "llm"], ["simple", "hyde"], [False, True])


@query("""SELECT embedder, retriever, reranker, strategy, two_call, concat_ws('__', embedder, retriever, reranker, strategy, CASE WHEN two_call THEN 'tc1' ELSE 'tc0' END) AS label FROM
  (VALUES ('voyage'), ('openai')) a(embedder), (VALUES ('vector'), ('bm25'), ('hybrid'), ('hierarchical')) b(retriever), (VALUES ('none'), ('rrf'), ('llm')) c(reranker), (VALUES ('simple'), ('hyde')) d(strategy), (VALUES (false), (true)) e(two_call)""")
def experiment_grid(spark, root):
    return judge.grid(spark, *_AXES)


@query(r"""SELECT c.id, r.answer AS reference FROM (SELECT DISTINCT id, question FROM chat_responses) c LEFT JOIN (SELECT q, arg_max_null(answer, ref_id) AS answer FROM (SELECT DISTINCT ref_id, answer, trim(question) AS q FROM reference_answers) GROUP BY q) r ON r.q = trim(c.question)""")
def reference_join(spark, root):
    q = table(spark, root, "chat_responses").select("id", F.col("question").alias("query")).distinct()
    refs = table(spark, root, "reference_answers").select("question", "answer", F.col("ref_id").alias("pos"))
    return judge.with_references(q, refs).select("id", "reference")


def queries() -> dict[str, Query]:
    from clauseworks.plans import system_queries  # noqa: F401  adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from clauseworks.plans import system_queries  # noqa: F401

    return dict(SQL)
