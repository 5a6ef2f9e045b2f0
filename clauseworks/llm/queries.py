"""The pN_ queries over the test tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm import abuse, mixture, neardup, packing, pairs, scans, split, topn
from clauseworks.operators.materialize import written
from clauseworks.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Production parameter: the weight schedule of each source of mix_targets, linear from share * (1 - slope) at the start of the
#: training to share * (1 + slope) at its end. Short everyday texts fall, dense rules and filings rise.
SLOPES = {
    "sms_polls": -0.8, "social_feed": -0.7, "youth_helpline": -0.6, "user_forum": -0.5, "legacy_scans": -0.5, "glossary_cards": -0.4, "complaint_desk": -0.3, "tape_archive": -0.2,
    "licence_faq": 0.2, "bangla_handbook": 0.3, "tariff_sheets": 0.3, "circular_archive": 0.4, "gazette_notes": 0.5, "operator_filings": 0.5, "court_digest": 0.7,
}


def question_pairs(spark: SparkSession, root: str) -> DataFrame:
    refs = table(spark, root, "reference_answers").select(F.lit("reference_answers").alias("pair_table"), F.col("ref_id").cast("string").alias("pair_key"), "question", "answer")
    chats = table(spark, root, "chat_responses").select(F.lit("chat_responses").alias("pair_table"), F.col("id").alias("pair_key"), "question", "answer")
    return refs.unionByName(chats)


def _provisions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "subsections").where(F.col("subsection_text").rlike(r"(?U)\S"))


def _named_text():
    return F.concat_ws(" ", F.coalesce("document_name", F.lit("")), "subsection_text")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs.defects(question_pairs(spark, root))


def p1_rates(spark: SparkSession, root: str) -> DataFrame:
    return pairs.rates(question_pairs(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.defects(table(spark, root, "subsections"))


def p2_repaired(spark: SparkSession, root: str) -> DataFrame:
    return scans.repair(table(spark, root, "subsections"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return split.boundary_levels(table(spark, root, "subsections"), "record_id", "subsection_text")


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split.split_pieces(table(spark, root, "subsections"), "record_id", "subsection_text")


def p3_rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """Every text put together again from its pieces without their overlaps, blanks left out; and whether pieces, overlaps and numbers keep their limits."""
    t = table(spark, root, "subsections").select("record_id", F.col("subsection_text").alias("t")).distinct()
    pieces = split.split_pieces(t, "record_id", "t")
    bare = lambda c: F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "")
    own = F.substring(F.col("piece"), F.col("overlap_chars") + 1, F.length("piece"))
    per = pieces.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("p"),  # one text's pieces
        F.max(F.length("piece")).alias("longest"), F.max("overlap_chars").alias("back"), F.count("*").alias("n"), F.max("total_pieces").alias("told"),
    )
    whole = bare(F.array_join(F.transform("p", lambda x: x["own"]), ""))
    return per.select("record_id", F.md5(whole).alias("text_md5"), ((F.col("longest") <= 2048) & (F.col("back") <= 204) & (F.col("n") == F.col("told"))).alias("within_limits"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_pairs(_provisions(spark, root), "record_id", _named_text(), threshold=0.7, words=3, exact=(F.col("document_name"), F.col("subsection_text")))


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_groups(_provisions(spark, root), "record_id", _named_text(), threshold=0.7, words=3)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return topn.top_n(table(spark, root, "variant_results"), "section", "score", "result_id", n=5).select("section", "result_id")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return packing.divided(packing.pack(table(spark, root, "documents")))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"))


def p6_checked(spark: SparkSession, root: str) -> DataFrame:
    """For every text: whether its parts are numbered, lie in containers that hold their capacity, and are more than one only where it alone exceeds one."""
    packed = written(packing.pack(table(spark, root, "documents")))
    loads = packed.groupBy("shard", "container").agg((F.sum("n_tokens") <= 8192).alias("held"))
    per = packed.join(loads, ["shard", "container"]).groupBy("doc_id").agg(F.bool_and("held").alias("held"), F.count("*").alias("n"), F.max("n_parts").alias("told"), F.max("part").alias("last"), F.sum("n_tokens").alias("tokens"))
    return per.select("doc_id", ((F.col("n") == F.col("told")) & (F.col("last") == F.col("n") - 1)).alias("numbered"), F.col("held").alias("within_capacity"), ((F.col("n") > 1) == (F.col("tokens") > 8192)).alias("divided_if_needed"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return mixture.short_sources(table(spark, root, "documents"), table(spark, root, "mix_targets"), slopes=SLOPES)


def p7_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixture.mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"), slopes=SLOPES)


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixture.shares(table(spark, root, "documents"), table(spark, root, "mix_targets"), slopes=SLOPES)


def p7_checked(spark: SparkSession, root: str) -> DataFrame:
    """For every target: whether no text is used more often than it may be, and the source is within its largest text of its demand, or used up."""
    documents, targets = table(spark, root, "documents"), table(spark, root, "mix_targets")
    sizes = written(mixture.sized(documents, "doc_id", "text", "source"))
    goals = written(mixture.plan(sizes, targets, slopes=SLOPES))
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    got = mixture.arrange(sizes, goals).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("repeat").alias("most"))
    rows = goals.join(largest, "source", "left").join(got, "source", "left").fillna(0, ["largest", "tokens", "most"])
    return rows.select("source", (F.col("most") <= F.col("max_repeats")).alias("repeats_held"), (F.abs(F.col("tokens") - F.col("used_tokens")) <= F.col("largest")).alias("share_met"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return abuse.found(table(spark, root, "documents"), table(spark, root, "review_samples"))


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    return abuse.scores(table(spark, root, "documents"), table(spark, root, "review_samples"))


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    return abuse.rates(table(spark, root, "documents"), table(spark, root, "review_samples"))


def queries() -> dict[str, Query]:
    own = (p1_found, p1_rates, p2_found, p2_repaired, p3_found, p3_pieces, p3_rebuilt, p4_found, p4_groups, p5_found, p6_found, p6_containers, p6_checked, p7_found, p7_mixture, p7_shares, p7_checked, p8_found, p8_scores, p8_rates)
    return {f.__name__: f for f in own}


_LEVEL = "list_max(list_transform(regexp_split_to_array(t, '{}'), lambda x: length(x))) <= 2048"

_RUNS = r"""
WITH plain AS (
  SELECT DISTINCT record_id, regexp_replace(lower(coalesce(document_name, '') || ' ' || subsection_text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]', ' ', 'g') AS t
  FROM subsections WHERE regexp_matches(subsection_text, '\S')),
words AS (SELECT record_id, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS w FROM plain),
runs AS (SELECT DISTINCT record_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS r FROM words WHERE len(w) >= 3)"""

ORACLES = {
    "p3_found": rf"""
SELECT DISTINCT record_id, CASE
  WHEN {_LEVEL.format(chr(92) + "n{2,}")} THEN 'paragraph'
  WHEN {_LEVEL.format(chr(92) + "n")} THEN 'line'
  WHEN list_max(list_transform(regexp_split_to_array(regexp_replace(t, '([.!?।])\s', '\1' || chr(10), 'g'), '\n'), lambda x: length(x))) <= 2048 THEN 'sentence'
  WHEN {_LEVEL.format(chr(92) + "s")} THEN 'space'
  ELSE 'none' END AS boundary
FROM (SELECT record_id, subsection_text AS t FROM subsections WHERE length(subsection_text) > 2048)
""",
    "p3_rebuilt": r"""
SELECT record_id, md5(regexp_replace(subsection_text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g')) AS text_md5, true AS within_limits
FROM (SELECT DISTINCT record_id, subsection_text FROM subsections) WHERE length(subsection_text) > 0
""",
    "p4_found": _RUNS + r""",
sizes AS (SELECT record_id, count(*) AS n FROM runs GROUP BY 1),
met AS (SELECT a.record_id AS record_a, b.record_id AS record_b, count(*) AS c FROM runs a JOIN runs b ON a.r = b.r AND a.record_id < b.record_id GROUP BY 1, 2)
SELECT record_a, record_b FROM met JOIN sizes x ON x.record_id = record_a JOIN sizes y ON y.record_id = record_b
WHERE c::DOUBLE / (x.n + y.n - c) >= 0.7
""",
    "p4_groups": _RUNS.replace("WITH plain", "WITH RECURSIVE plain") + r""",
sets AS (SELECT record_id, list_sort(list(r)) AS rs, count(*) AS n FROM runs GROUP BY 1),
classes AS (SELECT record_id, n, min(record_id) OVER (PARTITION BY rs) AS class_id FROM sets),
one AS (SELECT record_id, r FROM runs WHERE record_id IN (SELECT class_id FROM classes)),
met AS (SELECT a.record_id AS a, b.record_id AS b, count(*) AS c FROM one a JOIN one b ON a.r = b.r AND a.record_id <> b.record_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM met JOIN classes x ON x.record_id = a JOIN classes y ON y.record_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.7),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT record_id, class_id, least(class_id, coalesce((SELECT min(b) FROM reach WHERE a = class_id), class_id)) AS group_id, (SELECT count(*) FROM edges WHERE a = class_id) AS links FROM classes
""",
    "p5_found": """
SELECT section, result_id FROM (
  SELECT section, result_id, row_number() OVER (PARTITION BY section ORDER BY score DESC, result_id) AS r
  FROM (SELECT DISTINCT section, result_id, score FROM variant_results WHERE section IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)))
WHERE r <= 5
""",
    "p6_checked": "SELECT DISTINCT doc_id, true AS numbered, true AS within_capacity, true AS divided_if_needed FROM documents WHERE text <> ''",
    "p7_checked": "SELECT DISTINCT source, true AS repeats_held, true AS share_met FROM mix_targets WHERE source IS NOT NULL",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
