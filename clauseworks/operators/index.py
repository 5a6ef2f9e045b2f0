"""Keyword and vector indexes as tables: build, merge, remove, upsert, delete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.functions.text import keyword_tokens
from clauseworks.operators.materialize import written

#: Repeated keys that go to all tasks; with more of them whole rows are shuffled, with the same result.
REPEATED_KEYS = 100_000


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms): a row per document with all its tokens, so that a document's length, frequencies and score need no shuffle.

    A document delivered again counts once; texts are shuffled for that only where an id is repeated.
    """
    return tokenised(one_each(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", lambda rows: rows.dropDuplicates(["id"])))


def tokenised(rows: DataFrame) -> DataFrame:
    """The same of rows (id, text) that are one per document already."""
    return rows.select("id", keyword_tokens(F.col("text")).alias("terms"))


def corpus_stats(post: DataFrame) -> tuple[int, float]:
    """(documents, average length), documents without tokens included; two numbers."""
    n, tokens = post.agg(F.count("*"), F.sum(F.size("terms"))).first()
    return n, (tokens or 0) / n if n else 0.0


def term_stats(post: DataFrame, documents: int, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf): ln((N - df + 0.5) / (df + 0.5)); negative ones become `epsilon` times the mean over the vocabulary before."""
    df = post.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = written(df.withColumn("idf", idf))
    mean = df.agg(F.avg("idf")).first()[0]
    return df.withColumn("idf", F.when(F.col("idf") < 0, F.lit(epsilon * mean if mean is not None else 0.0)).otherwise(F.col("idf")))


def save(path: str, docs: DataFrame, id_col: str, text_col: str) -> None:
    """The keyword index of `docs` as tables below `path`: documents, postings, terms and corpus numbers."""
    spark = docs.sparkSession
    store = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    store(one_each(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", lambda rows: rows.dropDuplicates(["id"])), "documents")
    store(tokenised(spark.read.parquet(f"{path}/documents")), "postings")
    post = spark.read.parquet(f"{path}/postings")
    n, average = corpus_stats(post)
    store(term_stats(post, n), "terms")
    store(spark.createDataFrame([(n, average)], "documents bigint, average_length double"), "corpus")


def load(spark, path: str) -> tuple[DataFrame, DataFrame, int, float]:
    """(postings, terms, documents, average length) of a saved index."""
    n, average = spark.read.parquet(f"{path}/corpus").first()
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), n, average


def merge_new(existing: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Existing rows and the new ones with ids not seen before, the first of each."""
    fresh = new.dropDuplicates([id_col]).join(existing.select(id_col), id_col, "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def remove(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Without the given ids; ids that aren't there are ignored."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], *latest: str) -> DataFrame:
    """Insert or replace by key: new rows win over existing ones, among new ones the last by `latest`."""
    order = [F.col("_new").desc(), *[F.col(c).desc_nulls_last() for c in latest]]
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_first(both, keys, order).drop("_new")


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in `order`; limited to one per key on the map side before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") == 1).drop("_rn")


def one_each(rows: DataFrame, key: str, pick: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`pick`, which leaves one row of each key, over tables in which few keys are repeated: keys alone are shuffled to find those, and then only their rows.

    `rows` is read anew for each of these steps, so it should be a table or a light plan over one.
    """
    again = written(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key")))
    n = again.count()
    if n > REPEATED_KEYS:
        return pick(rows)
    if not n:
        return rows
    repeated = F.col(key).eqNullSafe(F.col("_key"))
    once = rows.join(F.broadcast(again), repeated, "left_anti")
    return once.unionByName(pick(rows.join(F.broadcast(again), repeated, "left_semi")))


def replace_by_source(existing: DataFrame, new: DataFrame, source: str, key: str) -> DataFrame:
    """Rows of the sources that come new are dropped, then the new ones upserted by key."""
    kept = existing.join(new.select(source).distinct(), source, "left_anti")
    return upsert(kept, new, [key], source)
