"""Tables published as snapshots: readers see the old one or the new one, whole.

``path/data/<name>`` holds a snapshot that nobody changes once it is written, with
its files, a manifest (name, bytes and SHA-256 of each file, made by tasks) and a
status.  ``path/versions/<number>.json`` names the snapshot of a version; readers
take the highest.  A publisher claims the next number by creating a file that must
not exist yet, so of two that start from one version only one succeeds.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


class VersionConflict(Exception):
    """Another publisher was there first."""


def _numbers(spark: SparkSession, path: str, ending: str) -> list[int]:
    names = (f.rsplit("/", 1)[-1] for f in files.children(spark, f"{path}/versions"))
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(ending) and n.split(".")[0].isdigit())


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file; whether it was not there before."""
    fs, p = files._filesystem(spark, path)
    try:
        fs.create(p, False).close()
        return True
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise


def latest(spark: SparkSession, path: str) -> int:
    """The number of the current version, 0 before the first."""
    return max(_numbers(spark, path, ".json"), default=0)


def current(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The record of a version (the latest): version, snapshot, status, files, published_at."""
    number = latest(spark, path) if version is None else version
    if not number:
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(f"{path}/versions/{number:012d}.json", wholetext=True).first()[0])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table of a version (the latest)."""
    return spark.read.parquet(f"{path}/data/{current(spark, path, version)['snapshot']}/table")


def _hashes(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish(df: DataFrame, path: str, expected: int | None = None) -> int:
    """Publish ``df`` as the next version and return its number.

    With ``expected`` the version that it replaces has to be that one, else
    ``VersionConflict``, as when another publisher claims the number meanwhile.
    A crash at any step leaves the old version in place, and at most a snapshot
    that no version names, or a claimed number, which ``release`` gives back.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    start = latest(spark, path)
    if expected is not None and expected != start:
        raise VersionConflict(f"version {start} is there, {expected} was expected")
    name = uuid.uuid4().hex
    folder = f"{path}/data/{name}"
    df.write.parquet(f"{folder}/table")
    _hashes(spark, f"{folder}/table").write.parquet(f"{folder}/manifest")
    n = spark.read.parquet(f"{folder}/manifest").count()
    files.write_text(spark, f"{folder}/status.json", json.dumps({"status": "complete", "files": n}))
    number = start + 1
    if not _create(spark, f"{path}/versions/{number:012d}.claim"):
        raise VersionConflict(f"version {number} was claimed by another publisher")
    record = {"version": number, "snapshot": name, "status": "complete", "files": n, "published_at": datetime.now(timezone.utc).isoformat()}
    staged = f"{path}/versions/.{name}"
    files.write_text(spark, staged, json.dumps(record))
    fs, p = files._filesystem(spark, staged)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{number:012d}.json")):
        raise OSError(f"could not publish version {number} of {path}")
    return number


def release(spark: SparkSession, path: str) -> None:
    """Give back numbers that a publisher claimed and died with; for times when none is at work."""
    done = set(_numbers(spark, path, ".json"))
    files.remove(spark, [f"{path}/versions/{n:012d}.claim" for n in _numbers(spark, path, ".claim") if n not in done])


def mismatches(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(name, problem) of files of a version that are missing, changed or not in its manifest."""
    folder = f"{path}/data/{current(spark, path, version)['snapshot']}"
    wanted = spark.read.parquet(f"{folder}/manifest").select("name", F.col("sha256").alias("wanted"))
    found = _hashes(spark, f"{folder}/table").select("name", "sha256")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("sha256") != F.col("wanted"), "changed")
    return wanted.join(found, "name", "full").select("name", problem.alias("problem")).where("problem is not null")
