"""A cache of replies that is read through: what it has is not asked again.

Entries are rows of Parquet files, in folders by the first two hexadecimal digits
of the request's key, so a lookup reads only the folders it needs.  Every run
writes a folder of its own, and Spark moves a file there only when it is whole;
no run changes another's files, so runs may go on at once.  Two that fetch the
same request leave two entries, of which all readers take the earlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import request_key
from ..storage import stored
from . import files, remote

ENTRY = "key string, path string, params map<string,string>, status int, body string, fetched_at timestamp, gone boolean"


class ResponseCache:
    """Replies under ``folder``; ``secrets`` are parameters that are no part of a request's key and are not kept."""

    def __init__(self, folder: str, secrets: Sequence[str] = ()):
        self.folder, self.secrets = folder.rstrip("/"), tuple(secrets)

    def key(self, path: Column, params: Column) -> Column:
        """sha256 of the path and its parameters in key order; no parameters are like null ones."""
        return request_key(path, F.coalesce(params, F.create_map().cast("map<string,string>")), self.secrets)

    def _rows(self, spark: SparkSession) -> DataFrame:
        if not files.exists(spark, self.folder):
            return spark.createDataFrame([], f"{ENTRY}, prefix string")
        return spark.read.schema(f"{ENTRY}, prefix string").option("basePath", self.folder).parquet(f"{self.folder}/run=*").drop("run")

    def entries(self, spark: SparkSession, keys: DataFrame | None = None) -> DataFrame:
        """One whole entry a key: the first since it was last invalidated.

        With ``keys`` (a column ``key``) only those, from the folders they are in.
        """
        rows = self._rows(spark)
        if keys is not None:
            asked = keys.select(F.substring("key", 1, 2).alias("prefix"), "key").distinct()
            folders = [r.prefix for r in asked.select("prefix").distinct().collect()]  # at most 256
            rows = rows.where(F.col("prefix").isin(folders)).join(asked.select("key"), "key", "left_semi")
        gone = F.max(F.when(F.col("gone"), F.col("fetched_at"))).alias("gone_at")
        rows = rows.where(~F.col("gone")).join(rows.groupBy("key").agg(gone), "key").where(F.col("gone_at").isNull() | (F.col("fetched_at") > F.col("gone_at")))
        entry = F.struct("path", "params", "status", "body", "fetched_at")
        return rows.groupBy("key").agg(F.min_by(entry, F.struct("fetched_at", "body")).alias("e")).select("key", "e.*")

    def _write(self, rows: DataFrame) -> None:
        # A folder of its own; files appear in it when they are whole.
        path = files.fresh_name(f"{self.folder}/run=")
        rows.withColumn("prefix", F.substring("key", 1, 2)).repartition("prefix").write.partitionBy("prefix").parquet(path)

    def put(self, replies: DataFrame) -> None:
        """Keep (path, params, status, body) of replies that are no errors."""
        kept = F.map_filter(F.coalesce("params", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*self.secrets))
        good = replies.where(remote.reply_error(F.col("status"), F.col("body")).isNull())
        self._write(good.select(
            self.key(F.col("path"), F.col("params")).alias("key"), "path", kept.alias("params"), F.col("status").cast("int").alias("status"), "body", F.current_timestamp().alias("fetched_at"), F.lit(False).alias("gone"),
        ))

    def invalidate(self, requests: DataFrame) -> None:
        """Forget the entries of these requests (path, params); what is fetched later counts again."""
        gone = requests.select(self.key(F.col("path"), F.col("params")).alias("key"), "path", "params").dropDuplicates(["key"])
        none = F.lit(None)
        self._write(gone.select("key", "path", none.cast("map<string,string>").alias("params"), none.cast("int").alias("status"), none.cast("string").alias("body"), F.current_timestamp().alias("fetched_at"), F.lit(True).alias("gone")))

    def stats(self, spark: SparkSession) -> DataFrame:
        """(entries, bytes): how many replies there are and how many UTF-8 bytes their bodies have."""
        return self.entries(spark).agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).cast("long").alias("bytes"))

    def compact(self, spark: SparkSession) -> None:
        """All runs as one; for times when no other run is at work."""
        if not files.exists(spark, self.folder):
            return
        old = files.children(spark, self.folder)
        self._write(stored(self.entries(spark).withColumn("gone", F.lit(False)), "cache"))
        files.remove(spark, old)

    def through(self, requests: DataFrame, fetcher: remote.Fetcher, **options) -> DataFrame:
        """``requests`` with key, status, body and whether each was asked now (``asked``).

        Equal requests are asked once.  Replies that are errors are returned and
        not kept.  ``options`` are those of ``remote.fetch``.  The requests are
        made when this is called.
        """
        spark = requests.sparkSession
        keyed = stored(requests.withColumn("key", self.key(F.col("path"), F.col("params"))), "requests")
        known = self.entries(spark, keyed)
        missing = keyed.dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
        found = stored(remote.fetch(missing.select("key", "path", "params"), fetcher, **options), "replies")
        self.put(found)
        # What another run kept first counts, but a reply that is no entry is returned as it came.
        kept = self.entries(spark, keyed).select("key", "status", "body")
        failed = found.join(kept, "key", "left_anti").select("key", "status", "body")
        asked = found.select("key", F.lit(True).alias("asked"))
        replies = kept.unionByName(failed).join(asked, "key", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        return keyed.join(replies, "key", "left")
