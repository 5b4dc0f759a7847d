"""Encoders as Arrow functions, and a cache that asks for misses only."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..batches import append_columns, slices, small_batches
from ..storage import stored
from . import files


class Embedder(Protocol):
    """Anything that turns a batch of texts into unit vectors."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors seeded by md5: equal texts have cosine 1, others near 0."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "little")).standard_normal(self.dim) for t in texts]
        m = np.array(rows).reshape(-1, self.dim)
        return m / np.linalg.norm(m, axis=1, keepdims=True)


class DigestEmbedder:
    """Unit vectors from the bytes of sha256, which SQL can compute as well."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        m = np.array([list(hashlib.sha256(t.encode()).digest()[: self.dim]) for t in texts], dtype=np.float64).reshape(-1, self.dim) - 127.5
        return m / np.linalg.norm(m, axis=1, keepdims=True)


#: Encoders by name.
EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder, "digest": DigestEmbedder}


def embedder(name: str, **options) -> Embedder:
    """The encoder of this name; an error that lists the known names if there is none."""
    if name not in EMBEDDERS:
        raise KeyError(f"no encoder {name!r}, there are {sorted(EMBEDDERS)}")
    return EMBEDDERS[name](**options)


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """Adds the vector of each text; a null text has a null vector.

    The encoder gets about ``SLICE_BYTES`` of text at a time, whatever the batch.
    """
    small_batches(df.sparkSession)
    own = df.drop(out)
    at = own.columns.index(text)

    def run(batches):
        for b in slices(batches, at):
            texts = b.column(at).to_pylist()
            vectors: list = [None] * len(texts)
            if some := [i for i, t in enumerate(texts) if t is not None]:
                for i, v in zip(some, embedder.encode([texts[i] for i in some]).astype("float32")):
                    vectors[i] = v
            yield append_columns(b, **{out: pa.array(vectors, pa.list_(pa.float32()))})

    return own.mapInArrow(run, StructType([*own.schema.fields, StructField(out, ArrayType(FloatType()))]))


def cached_embed(df: DataFrame, text: str, cache: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(vectors of all texts by hash, rows to append to the cache).

    ``cache`` has text_hash and embedding.  Each distinct text that it lacks is
    encoded once.
    """
    keyed = df.select(F.sha2(text, 256).alias("text_hash"), F.col(text).alias("_t")).where("_t is not null").dropDuplicates(["text_hash"])
    new = embed(keyed.join(cache, "text_hash", "left_anti"), "_t", embedder).select("text_hash", "embedding")
    return keyed.select("text_hash").join(cache.unionByName(new), "text_hash"), new


class EmbeddingCache:
    """Vectors by the hash of their text, kept under ``folder`` per encoder.

    Each run writes a folder of its own, split by the first two hexadecimal
    digits of the hash, so runs may go on at once and a lookup reads only the
    folders it needs.  Two runs that encode one text leave two rows, of which
    readers take one; an encoder gives equal texts equal vectors.
    """

    def __init__(self, folder: str, encoder: str):
        self.folder = f"{folder.rstrip('/')}/encoder={encoder}"

    def vectors(self, spark: SparkSession, prefixes: list[str] | None = None) -> DataFrame:
        """(text_hash, embedding), one row a text; only of these folders if ``prefixes`` are given."""
        schema = "text_hash string, embedding array<float>, prefix string"
        if not files.exists(spark, self.folder):
            return spark.createDataFrame([], schema).drop("prefix")
        rows = spark.read.schema(schema).option("basePath", self.folder).parquet(f"{self.folder}/run=*")
        if prefixes is not None:
            rows = rows.where(F.col("prefix").isin(prefixes))
        return rows.groupBy("text_hash").agg(F.first("embedding").alias("embedding"))

    def append(self, rows: DataFrame) -> None:
        split = rows.select("text_hash", "embedding", F.substring("text_hash", 1, 2).alias("prefix"))
        split.repartition("prefix").write.partitionBy("prefix").parquet(files.fresh_name(f"{self.folder}/run="))

    def through(self, df: DataFrame, text: str, encoder: Embedder) -> tuple[DataFrame, int]:
        """((text_hash, embedding) of all texts, number of texts that were encoded now).

        Null texts have no vector.  Each distinct text that the cache lacks is
        encoded once and kept before this returns.
        """
        spark = df.sparkSession
        keyed = stored(df.select(F.sha2(text, 256).alias("text_hash"), F.col(text).alias("_t")).where("_t is not null").dropDuplicates(["text_hash"]), "texts")
        folders = [r.p for r in keyed.select(F.substring("text_hash", 1, 2).alias("p")).distinct().collect()]  # at most 256
        missing = keyed.join(self.vectors(spark, folders).select("text_hash"), "text_hash", "left_anti")
        new = stored(embed(missing, "_t", encoder).select("text_hash", "embedding"), "vectors")
        if n := new.count():
            self.append(new)
        return keyed.select("text_hash").join(self.vectors(spark, folders), "text_hash"), n

    def compact(self, spark: SparkSession) -> None:
        """All runs as one; for times when no other run is at work."""
        if files.exists(spark, self.folder):
            old = files.children(spark, self.folder)
            self.append(stored(self.vectors(spark), "vectors"))
            files.remove(spark, old)
