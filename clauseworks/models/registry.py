"""Named plug-ins and their deterministic offline implementations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.functions.text import keyword_tokens, strip, token_set


class Registry:
    """Plug-ins of a family by name; case and outer blanks don't count, a later one of a name replaces the earlier."""

    def __init__(self, family: str):
        self.family, self._held = family, {}

    def add(self, name: str) -> Callable:
        def keep(plugin):
            self._held[name.strip().lower()] = plugin
            return plugin

        return keep

    def get(self, name: str):
        try:
            return self._held[name.strip().lower()]
        except KeyError:
            raise KeyError(f"unknown {self.family} {name!r}; there are {', '.join(self.names)}") from None

    @property
    def names(self) -> list[str]:
        return sorted(self._held)


EMBEDDERS, CHUNKERS, STRATEGIES, RETRIEVERS, RERANKERS, JUDGES = map(Registry, ("embedder", "chunker", "strategy", "retriever", "reranker", "judge"))


@EMBEDDERS.add("hashing")
def hashing_embedder(text: Column, dimension: int = 64) -> Column:
    """Unit vectors of signed token hashes: the same text always has the same vector, shared words give likeness."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for lines in batches:
            out = []
            for line in lines:
                v = np.zeros(dimension)
                for w in line.split(" ") if line else ():
                    h = xxhash.xxh64_intdigest(w)
                    v[h % dimension] += 1.0 if h >> 63 else -1.0
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pd.Series(out)

    return embed(F.array_join(keyword_tokens(text), " "))  # a text goes to Python as one string, not as an object per word


@RERANKERS.add("overlap")
def overlap_scores(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, model_score 0..10): the part of the query's words that a text has; stands in for a cross-encoder."""
    pairs = hits.join(queries.select("query_id", token_set(F.col("query")).alias("_q")), "query_id")
    share = F.size(F.array_intersect("_q", token_set(F.col("text")))) / F.greatest(F.lit(1), F.size("_q"))
    return pairs.select("query_id", "id", F.round(10 * share, 2).alias("model_score"))


@STRATEGIES.add("simple")
def simple(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.array("query").alias("queries"))


@STRATEGIES.add("decompose")
def decompose(queries: DataFrame) -> DataFrame:
    """Parts of a question joined by "and" or a semicolon."""
    return queries.select("query_id", F.filter(F.transform(F.split("query", r"(?i)\s+and\s+|;"), strip), lambda q: q != "").alias("queries"))


@STRATEGIES.add("diversify")
def diversify(queries: DataFrame) -> DataFrame:
    """Four wordings of a question."""
    q = F.col("query")
    return queries.select("query_id", F.array(q, F.concat(F.lit("explain "), q), F.concat(F.lit("rules on "), q), F.array_join(keyword_tokens(q), " ")).alias("queries"))


@STRATEGIES.add("abstract")
def abstract(queries: DataFrame) -> DataFrame:
    """A more general question: its words without figures."""
    return queries.select("query_id", F.array(strip(F.regexp_replace("query", r"[0-9][0-9.,()]*", ""))).alias("queries"))


@STRATEGIES.add("hyde")
def hypothetical(queries: DataFrame) -> DataFrame:
    """The question with a made-up answer below it."""
    return queries.select("query_id", F.array(F.concat(F.col("query"), F.lit("\n\n"), F.concat(F.lit("The provision states: "), F.array_join(keyword_tokens(F.col("query")), " ")))).alias("queries"))


def _shared(part: str, whole: str) -> Column:
    """1..5 by the part of one text's words that another has; 0 ("not evaluated") where either has no words."""
    a, b = token_set(F.col(part)), token_set(F.col(whole))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise((1 + F.round(4 * share)).cast("int"))


# Judges without a model: (metric, the text whose words are looked for, the text they are looked for in).
OFFLINE_JUDGES = {"context_relevance": ("ctx_precision", "query", "context"), "context_sufficiency": ("ctx_sufficiency", "query", "context"), "faithfulness": ("faithfulness", "response", "context"), "answer_correctness": ("correctness", "reference", "response"), "answer_relevance": ("answer_relevance", "query", "response")}
for _name, (_metric, _part, _whole) in OFFLINE_JUDGES.items():
    JUDGES.add(_name)(lambda rows, m=_metric, p=_part, w=_whole: rows.withColumn(m, _shared(p, w)))


def judged(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows (query, context, response, reference) with the metrics of the named judges."""
    for n in names:
        rows = JUDGES.get(n)(rows)
    return rows


def keyword_gaps(contexts: DataFrame, queries: DataFrame, least: float = 0.5) -> DataFrame:
    """Gap analyses without a model: a context is sufficient that has at least `least` of the query's keywords; else the missing ones are asked for."""
    rows = contexts.join(queries.select("query_id", F.array_distinct(keyword_tokens(F.col("query"))).alias("_q")), "query_id")
    missing = F.array_except("_q", keyword_tokens(F.col("context")))
    share = 1 - F.size(missing) / F.greatest(F.lit(1), F.size("_q"))
    words = F.array_join(missing, " ")
    return rows.select("query_id", F.format_string("%d of %d keywords missing", F.size(missing), F.size("_q")).alias("reasoning"), (share >= least).alias("sufficient"), words.alias("missing_info"), F.when(share < least, F.array(words)).otherwise(F.array().cast("array<string>")).alias("followup_queries"))


def offline_gaps(contexts: DataFrame) -> DataFrame:
    """Gap analyses without a model: sufficient whatever the context."""
    return contexts.select("query_id", F.lit("no model").alias("reasoning"), F.lit(True).alias("sufficient"), F.lit("").alias("missing_info"), F.array().cast("array<string>").alias("followup_queries"))
