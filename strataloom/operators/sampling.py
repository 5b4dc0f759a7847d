"""Deterministic samples: rows ordered by md5 of "id:seed"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return df.orderBy(draw(key, seed), key).limit(n)


def per_stratum(df: DataFrame, stratum: str, key: str, seed: int, n: int) -> DataFrame:
    """n rows of each stratum; all of a smaller one."""
    w = Window.partitionBy(stratum).orderBy(draw(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def at_rate(df: DataFrame, stratum: str, key: str, seed: int, rate: float) -> DataFrame:
    """A share of each stratum, rounded down, at least one row."""
    sizes = df.groupBy(stratum).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(rate))).alias("_n"))
    w = Window.partitionBy(stratum).orderBy(draw(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).join(sizes, stratum).where("_r <= _n").drop("_r", "_n")


def capped(df: DataFrame, stratum: str, key: str, seed: int, total: int) -> DataFrame:
    """Equal quota per stratum (rounded up), then trimmed to ``total`` rows."""
    strata = max(1, df.select(stratum).distinct().count())
    return per_stratum(df, stratum, key, seed, -(-total // strata)).orderBy(draw(key, seed), key).limit(total)


def hardest(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n rows with the lowest score."""
    return df.orderBy(F.asc(score), key).limit(n)
