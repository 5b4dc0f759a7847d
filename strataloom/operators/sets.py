"""Set algebra on keys and tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(parts: dict[str, DataFrame], status: str = "status") -> DataFrame:
    """All rows with the name of their part; columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(status, F.lit(k)) for k, df in parts.items()])


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys only in a ("extra") and only in b ("missing")."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("extra")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("missing")))


def attribute_diff(a: DataFrame, b: DataFrame, key: Column, attribute: str) -> DataFrame:
    """(key, change, before, after): lost, gained and changed by key."""
    x = a.groupBy(key.alias("key")).agg(F.min(attribute).alias("before"), F.lit(True).alias("_x"))
    y = b.groupBy(key.alias("key")).agg(F.min(attribute).alias("after"), F.lit(True).alias("_y"))
    change = F.when(F.col("_y").isNull(), "lost").when(F.col("_x").isNull(), "gained").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return x.join(y, "key", "full").withColumn("change", change).where("change is not null").select("key", "change", "before", "after")


def overlaps(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(a, b, n): the number of common keys of every two parts."""
    marked = union_all({k: v.select(key).distinct() for k, v in parts.items()}, "part")
    common = marked.alias("x").join(marked.alias("y"), key).where("x.part < y.part").groupBy(F.col("x.part").alias("a"), F.col("y.part").alias("b")).agg(F.count("*").alias("n"))
    pairs = marked.sparkSession.createDataFrame([tuple(sorted(p)) for p in combinations(parts, 2)], "a string, b string")
    return pairs.join(common, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def may_merge(sim: Column, least: float, a_source: Column, b_source: Column, prefix: str, a_items: Column, b_items: Column, overlap: float) -> Column:
    """Similar enough, and if both rows are item sets of one source, overlapping enough."""
    both = a_source.startswith(prefix) & b_source.startswith(prefix) & (F.size(a_items) > 0) & (F.size(b_items) > 0)
    return (sim >= least) & (~both | (jaccard(a_items, b_items) >= overlap))


def drop_category(concepts: DataFrame, prompts: DataFrame, key: str, category: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without a category's rows, and a summary; nothing is written."""
    gone = concepts.where(F.col(category) == value).select(key).distinct()
    kept_concepts = concepts.where(~F.col(category).eqNullSafe(F.lit(value)))
    kept_prompts = prompts.join(gone, key, "left_anti")
    summary = gone.agg(F.count("*").alias("concepts")).join(prompts.join(gone, key, "left_semi").agg(F.count("*").alias("prompts")))
    return kept_concepts, kept_prompts, summary


def ending_pairs(df: DataFrame, word: str, ending: str = "s") -> DataFrame:
    """(singular, plural): distinct words of which one is the other with an ending; nulls are none."""
    words = df.select(F.col(word).alias("singular")).where("singular is not null").distinct()
    plural = words.where(F.col("singular").endswith(ending)).select(F.col("singular").alias("plural"))
    return words.withColumn("plural", F.concat("singular", F.lit(ending))).join(plural, "plural", "left_semi").select("singular", "plural")
