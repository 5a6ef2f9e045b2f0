"""Writers: versioned tables, keyed upserts, JSON and CSV results."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.operators.index import remove, replace_by_source, upsert
from clauseworks.operators.judge import union_of_results


class Store:
    """Small files on whatever file system a path names: local, HDFS or an object store."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


class VersionedTable:
    """A Parquet table whose versions are written beside each other, on any file system. A small file named by the version's number commits it.

    The highest number counts. A run that fails leaves no such file, so readers stay with the version before; no file is
    ever replaced, so the commit needs no atomic renaming. Writers read the current version and write the next.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema, self.store = spark, str(path).rstrip("/"), schema, Store(spark)

    def _numbers(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.store.names(f"{self.path}/commits") if n[:1] == "c" and n[1:].isdigit())

    @property
    def exists(self) -> bool:
        return bool(self._numbers())

    def read(self) -> DataFrame:
        if not self.exists:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.store.read(f'{self.path}/commits/c{self._numbers()[-1]:08d}')}")

    def create(self) -> bool:
        """Whether the table was created now."""
        if self.exists:
            return False
        self.write(self.spark.createDataFrame([], self.schema))
        return True

    def write(self, rows: DataFrame, *partition_by: str) -> None:
        name, last = f"v{uuid.uuid4().hex}", max(self._numbers(), default=0)
        rows.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        self.store.write(f"{self.path}/commits/c{last + 1:08d}", name)

    def vacuum(self, keep: int = 2) -> int:
        """Removes all versions but the last `keep`, and those never committed; how many were removed."""
        held = self._numbers()
        names = {self.store.read(f"{self.path}/commits/c{n:08d}"): n for n in held}
        stay = {v for v, n in names.items() if n in held[-keep:]}
        gone = [v for v in self.store.names(self.path) if v[:1] == "v" and v not in stay]
        for n in held[:-keep]:
            self.store.delete(f"{self.path}/commits/c{n:08d}")
        for v in gone:
            self.store.delete(f"{self.path}/{v}")
        return len(gone)

    def upsert(self, rows: DataFrame, keys: list[str], *latest: str) -> None:
        self.write(upsert(self.read(), rows, keys, *latest))

    def delete(self, ids: DataFrame, id_col: str = "id") -> None:
        self.write(remove(self.read(), ids, id_col))

    def replace_sources(self, rows: DataFrame, source: str, key: str) -> None:
        self.write(replace_by_source(self.read(), rows, source, key))


def write_json(rows: DataFrame, path: str, *partition_by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_trace(run: dict, traces: DataFrame, path: str) -> None:
    """A run's header beside its queries' nested traces, one JSON document a query."""
    traces.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/queries")
    Store(traces.sparkSession).write(f"{path.rstrip('/')}/run.json", json.dumps(run, indent=2, ensure_ascii=False))


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header, quotes doubled, and blanks at the ends of cells kept."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_results(path: str, *frames: DataFrame) -> None:
    """Result tables as one CSV: the union of their columns in order, blanks for what is missing."""
    write_csv(union_of_results(*frames), path)


def packed_artifact(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds sha256, compression, sizes and the gzip payload of a binary column."""

    @F.pandas_udf("binary")
    def pack(c: pd.Series) -> pd.Series:
        return c.map(lambda b: None if b is None else gzip.compress(bytes(b), mtime=0))

    out = rows.withColumns({"sha256": F.sha2(content, 256), "compression": F.lit("gzip"), "raw_size": F.octet_length(content), "payload": pack(F.col(content))})
    return out.withColumn("packed_size", F.octet_length("payload")).drop(content)


def changed_artifacts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Artifacts whose digest isn't stored yet."""
    return new.join(stored.select("chunker", "artifact_name", "sha256"), ["chunker", "artifact_name", "sha256"], "left_anti")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
