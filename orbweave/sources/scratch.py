"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="orbweave-"))
    return _OWN[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/orbweave/{name}-{uuid.uuid4().hex}"


@contextmanager
def _once(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within go when it is written, not when the driver's collector finds its plan."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was) if was is not None else spark.conf.unset(_CLEANUP)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: its lineage ends at durable files."""
    path = new_path(df.sparkSession, name)
    with _once(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bucketed(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``df`` as a written table in buckets by ``columns``: joins on these leave it where it lies."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "orbweave_" + path.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # dealt as the buckets are, so that each is one file
    with _once(spark):
        df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)
