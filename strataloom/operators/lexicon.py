"""Inclusion views, clean views and merged banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def inclusion(df: DataFrame, key: str, always: Column, matched: DataFrame, reason: str) -> DataFrame:
    """Adds included and why: always in, then matched, then rows without a reason.

    A row left out has its exclusion reason as why.
    """
    m = matched.select(F.col(key)).distinct().withColumn("_m", F.lit(True))
    out = df.join(m, key, "left")
    hit = F.coalesce("_m", F.lit(False))
    included = always | hit | F.col(reason).isNull()
    why = F.when(always, "reference").when(hit, "matched").when(F.col(reason).isNull(), "passed").otherwise(F.col(reason))
    return out.withColumns({"included": included, "why": why}).drop("_m")


def keep_first(df: DataFrame, group: list[Column], order: list[Column]) -> DataFrame:
    """Adds kept: whether the row is the first of its group in this order."""
    return df.withColumn("kept", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1)


def dedup_mapping(df: DataFrame, key: str, group: list[Column], order: list[Column]) -> DataFrame:
    """(dropped, kept): every later row of a group and the first one it stands for."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.select(F.col(key).alias("dropped"), F.first(key).over(w).alias("kept"), F.row_number().over(w).alias("_r")).where("_r > 1").drop("_r")


def clean_view(
    concepts: DataFrame, prompts: DataFrame, key: str, name: str, tier: str, reference: Column, dropped: DataFrame, sets: dict[str, str], wanted_species: dict[str, str]
) -> DataFrame:
    """Prompts of a view without listed concepts, duplicates and other species.

    Concepts in ``dropped`` go first.  Of concepts with one normalised name in a
    tier the reference one stays, then the one with the lowest number in its
    id.  A tier's embedding set comes from ``sets`` (unknown tiers are an
    error); a set with an entry in ``wanted_species`` keeps that species only.
    """
    left = concepts.join(dropped.select(key), key, "left_anti")
    order = [reference.desc(), tx.id_number(F.col(key).cast("string")), F.col(key)]
    first = keep_first(left, [F.col(tier), tx.normalize_name(F.col(name))], order).where("kept").drop("kept")
    marked = first.select(key, F.col(name), tier, tx.map_or_fail(F.col(tier), sets).alias("embedding_set"))
    out = prompts.join(marked, key)
    for s, species in wanted_species.items():
        out = out.where((F.col("embedding_set") != s) | (F.col("species") == species))
    return out


def dropped_ids(df: DataFrame, key: str, group: list[Column], order: list[Column]) -> DataFrame:
    """The ids that deduplication drops: all of a group but the first in this order."""
    return dedup_mapping(df, key, group, order).select(F.col("dropped").alias(key))


def view_rows(df: DataFrame, flag: str) -> DataFrame:
    """The rows whose flag is true; all rows if the table has no such column."""
    return df.where(F.coalesce(F.col(flag), F.lit(False))) if flag in df.columns else df
