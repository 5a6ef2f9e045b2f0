"""Cutting lineage through a shared folder, so that a lost executor loses no result."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_clean: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`; in a session without one (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="clauseworks-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is removed when the program ends, or before that by `discard`."""
    app = spark.sparkContext.applicationId
    if app not in _clean:
        _clean.add(app)
        atexit.register(discard, spark)
    return f"{shared_folder(spark)}/clauseworks/{app}"


def discard(spark: SparkSession) -> None:
    """Removes the tables this application has written; frames that read them can't be used any more."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/clauseworks/{spark.sparkContext.applicationId}")
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001  a session that has stopped can't remove anything
        return


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame it survives the loss of any executor; unlike an RDD checkpoint
    it stays columnar, so later readers prune its columns and partitions.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(_nullable(df, partition_by)).parquet(path)


def _nullable(df: DataFrame, partition_by: tuple[str, ...]):
    from pyspark.sql.types import StructField, StructType

    fields = [f for f in df.schema.fields if f.name not in partition_by] + [df.schema[c] for c in partition_by]
    return StructType([StructField(f.name, f.dataType, True) for f in fields])
