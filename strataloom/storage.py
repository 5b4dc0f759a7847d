"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
#: Rows of a file, and the least files, of a small table whose rows are about known.
FILE_ROWS, LEAST_FILES = 200_000, 4


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without the setting gets a folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="strataloom-"))
    return f"file://{_own_folder[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/strataloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Compute ``df`` once into the shared folder and read it back.

    ``rows``, about how many of them there are at most, is for tables of keys and numbers:
    they are dealt out anew to as many files as that asks for.  A file a shuffle partition
    would be many small ones, and on a local folder Hadoop starts processes for each.
    """
    if rows is not None:
        df = df.repartition(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/strataloom-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
