"""Written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="orbweave-"))
    return _OWN[0]


def written(df: DataFrame, name: str, rows_in_file: int = 0) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends at durable files.

    ``rows_in_file``: the most rows of a file, if any; a reader decodes a file's rows together, so large ones go one by one.
    """
    path = f"{shared_dir(df.sparkSession)}/orbweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_in_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads, and let go of the shuffle files of finished steps."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            spark._jvm.System.gc()  # shuffle files go when the driver's JVM finds their plans unreachable


def spare(columns: list[str], *names: str) -> list[str]:
    """``names``, each made longer until no column has it (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
