"""Scans of the files a document pipeline leaves behind: pages, chunk caches, question and answer lists, results, traces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseworks.functions.text import is_blank, strip

CHUNK_FILE = "array<struct<id:string,text:string,metadata:map<string,string>>>"


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, modificationTime, length, content) of matching files; order by path where order matters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def parsed_pages(files: DataFrame, parse: Callable[[bytes], list[str]], parsed: DataFrame | None = None) -> DataFrame:
    """(doc, page, text, error): one row per page of each file by a pluggable parser; a file that can't be parsed gives a row with its error.

    Documents with pages among `parsed` (doc, error, ...) aren't parsed again, those of which only an error is there are.
    """
    if parsed is not None:
        done = parsed.where(F.col("error").isNull()).select("doc").distinct()
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
        files = files.withColumn("doc", stem).join(done, "doc", "left_anti").drop("doc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                doc = Path(path).stem
                try:
                    rows += [(doc, i, t, None) for i, t in enumerate(parse(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  one bad file mustn't end the run
                    rows.append((doc, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc", "page", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "doc string, page int, text string, error string")


def markdown_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, page, text) of one markdown file per page: ordered by the number that ends a name, names without one last; `page` is the place, not the number."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(folder).withColumn("path", F.input_file_name())
    doc, stem = F.element_at(F.split("path", "/"), -2), F.regexp_extract("path", r"([^/]+)\.md$", 1)
    number = F.coalesce(F.expr(r"try_cast(regexp_extract(path, '_([0-9]+)[.]md$', 1) AS INT)"), F.lit(10**9))
    rows = raw.select(doc.alias("doc"), number.alias("_n"), stem.alias("_stem"), F.col("value").alias("text"))
    return rows.withColumn("page", F.row_number().over(Window.partitionBy("doc").orderBy("_n", "_stem"))).select("doc", "page", "text")


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON array files; a missing path gives no rows where a schema is named."""
    reader = spark.read.option("multiLine", True)
    if schema:
        if not list_paths(spark, path):
            return spark.createDataFrame([], schema)
        reader = reader.schema(schema)
    return reader.json(path)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that match, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [str(x.getPath()) for x in found or []]


def backfilled_seq(rows: DataFrame, doc: str = "doc_name", order: str = "id") -> DataFrame:
    """`seq` where it is missing: the place in the document by `order`, from 0."""
    place = (F.row_number().over(Window.partitionBy(F.coalesce(doc, F.lit(""))).orderBy(order)) - 1).cast("int")
    return rows.withColumn("seq", F.coalesce(F.col("seq"), place) if "seq" in rows.columns else place)


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, subsection_text, full_subsection_text, bm25_text, chunker, source_file) of all chunk caches below a folder.

    Of an id in several files the one in the last path counts; an empty full or keyword text is the chunk's text.
    """
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*chunks__*.json").schema("id string, text string, metadata map<string,string>").json(folder)
    raw = raw.withColumn("path", F.input_file_name()).where(F.col("id").isNotNull())
    m = lambda k: F.nullif(F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("")), F.lit(""))
    text = F.coalesce(m("subsection_text"), F.col("text"), F.lit(""))
    row = F.struct(text.alias("subsection_text"), F.coalesce(m("full_subsection_text"), text).alias("full_subsection_text"), F.coalesce(m("bm25_text"), text).alias("bm25_text"), chunker_of(F.col("path")).alias("chunker"), F.element_at(F.split("path", "/"), -1).alias("source_file"))
    return raw.groupBy("id").agg(F.max_by(row, "path").alias("r")).select("id", "r.*")


def chunker_of(path):
    """The chunker that a cache file is named after."""
    return F.regexp_extract(path, r"chunks__([^/]+)\.json$", 1)


def chunkers(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct chunker names of file names, sorted."""
    return paths.select(chunker_of(F.col(column)).alias("chunker")).where("chunker <> ''").distinct().orderBy("chunker")


def question_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(query_id, query) of the first column of a CSV with a header, blank rows skipped, in file order; 0 or no limit reads all."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.select(strip(F.col(raw.columns[0])).alias("query"), F.monotonically_increasing_id().alias("_p")).where(~is_blank(F.col("query")))
    rows = rows.orderBy("_p").limit(limit) if limit else rows
    return rows.withColumnRenamed("_p", "query_id")


def reference_list(spark: SparkSession, path: str, strip_answers: bool = False) -> DataFrame:
    """(question, answer, pos) by stripped question, the last of equal ones; a missing file gives no rows."""
    schema = "question string, answer string"
    if not list_paths(spark, path):
        return spark.createDataFrame([], f"{schema}, pos bigint")
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    rows = raw.select(strip(F.col("question")).alias("question"), (strip(F.col("answer")) if strip_answers else F.col("answer")).alias("answer"), F.monotonically_increasing_id().alias("pos"))
    return rows.where(~is_blank(F.col("question"))).groupBy("question").agg(F.max_by("answer", "pos").alias("answer"), F.max("pos").alias("pos"))


def response_list(spark: SparkSession, path: str) -> DataFrame:
    """(query, response) of CSV rows with at least two columns."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    a, b = raw.columns[:2]
    return raw.select(F.col(a).alias("query"), F.col(b).alias("response")).where("response IS NOT NULL")


def result_list(spark: SparkSession, path: str) -> DataFrame:
    """Judge results: every column whose values can be numbers in whole is read as such, cell by cell; other cells are null there and kept as text beside it."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*raw.columns, *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(f"{c}_number") for c in raw.columns])


def run_traces(spark: SparkSession, *folders: str) -> DataFrame:
    """Traces of runs with their files, the newest run first; earlier folders come before later ones."""
    out = None
    for i, folder in enumerate(folders):
        rows = spark.read.option("multiLine", True).json(f"{folder}/*.json").withColumns({"_folder": F.lit(i), "file": F.input_file_name()})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.orderBy("_folder", F.col("file").desc()).drop("_folder")


def by_ids(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows with the asked ids; ids that aren't there are absent."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_semi")


def restored_artifacts(rows: DataFrame) -> DataFrame:
    """(chunker, artifact_name, content) of stored artifacts, unpacked; another compression than gzip or a digest that differs is an error."""
    import gzip

    @F.pandas_udf("binary")
    def unpack(payload: pd.Series) -> pd.Series:
        return payload.map(lambda b: None if b is None else gzip.decompress(bytes(b)))

    checked = F.when(F.col("compression") != "gzip", F.raise_error(F.concat(F.lit("unknown compression: "), F.col("compression")))).otherwise(F.col("payload"))
    out = rows.select("chunker", "artifact_name", "sha256", unpack(checked).alias("content"))
    good = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("artifact_name"))))
    return out.select("chunker", "artifact_name", good.alias("content"))


def settings(path: str, default: object = None):
    """A small YAML file on the driver; a missing one gives the default."""
    if not Path(path).exists():
        return default
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML settings needs PyYAML") from e
    return yaml.safe_load(Path(path).read_text())
