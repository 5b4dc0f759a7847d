"""Concept profiles of groups, their stability and their ranking."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import vectors as vx
from ..storage import stored
from . import ranking
from .joins import ordered_pairs

#: Profiles in a block, and profiles (one vector a group) that may be broadcast.
PROFILES = 256
BROADCAST_PROFILES = 4096
#: Scores of a block of concepts.
CELLS = 1 << 20


def contrastive_scores(members: DataFrame, group: str, score: str, key: str, vector: str, concepts: DataFrame, concept: str, k: int, top: int | None = None) -> DataFrame:
    """(group, concept, score, rank): cosine of concepts with what sets a group apart.

    With ``top`` only so many concepts of a group are ranked, and Spark drops the
    others before they are shuffled; without it all are, in sorted ranges.

    A group's profile is the mean of the unit vectors of its k best members
    minus the mean over all its members, scaled to unit length.  The concept
    table is scored against one profile per group.
    """
    unit = members.select(group, score, key, vx.normalize(F.col(vector)).alias("_u"))
    best = ranking.top_n(unit, [group], [F.desc(score), F.col(key)], k)
    a = vx.centroid(best, group, "_u", unit=False).withColumnRenamed("centroid", "_top")
    b = vx.centroid(unit, group, "_u", unit=False).withColumnRenamed("centroid", "_all")
    profile = a.join(b, group).select(group, vx.normalize(vx.subtract(F.col("_top"), F.col("_all"))).alias("_p"))
    # The profiles are the queries, in blocks of ``PROFILES``; a concept meets each block once.
    profile = stored(profile.where("_p is not null"), "profiles")
    n = profile.count()
    blocks = profile.groupBy(F.pmod(F.xxhash64(group), F.lit(max(1, math.ceil(n / PROFILES)))).alias("_b")).agg(F.collect_list(F.struct(group, "_p")).alias("_ps"))
    own = concepts.select(concept, vx.normalize(F.col(vector)).alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, math.ceil(n / PROFILES)) - 1).cast("long"))).alias("_b")).where("_c is not null")
    met = own.join(F.broadcast(blocks) if n <= BROADCAST_PROFILES else blocks, "_b").select(concept, "_c", F.explode("_ps").alias("_p"))
    s = met.select(F.col(f"_p.{group}").alias(group), concept, F.round(vx.dot(F.col("_c"), F.col("_p._p")), 9).alias("score"))
    order = [F.desc("score"), F.col(concept)]
    return ranking.spread_rank(s, [group], order) if top is None else ranking.top_n(s, [group], order, top)


SUMS = ("n", "x", "y", "xx", "yy", "xy")


def stability(scores: DataFrame, expert: str, slide: str, concept: str, score: str, block: int = CELLS) -> DataFrame:
    """(expert, a, b, pearson, spearman, n) for every two slides of an expert that share a concept.

    Concepts come in blocks of about ``block`` scores.  A task makes a matrix of
    slides and concepts of its block, and products of such matrices are the sums
    over concepts that all correlations need; rows of two slides are never
    paired.  A (expert, slide, concept) occurs once; rows with a null do not count.
    """
    known = scores.select(F.col(expert).alias("expert"), F.col(slide).alias("slide"), F.col(concept).alias("concept"), F.col(score).cast("double").alias("v")).where("expert is not null and slide is not null and concept is not null and v is not null")
    ranked = ranking.spread_tied_rank(known, ["expert", "slide"], "v", "r")
    blocks = known.groupBy("expert").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    dealt = ranked.join(blocks, "expert").withColumn("_block", F.pmod(F.xxhash64("concept"), F.col("_blocks")))
    kinds = [f"{c}{k}" for c in ("v_", "r_") for k in SUMS]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        slides, at = np.unique(pdf["slide"].to_numpy(), return_inverse=True)
        _, column = np.unique(pdf["concept"].to_numpy(), return_inverse=True)
        shape = (len(slides), int(column.max()) + 1)
        there = np.zeros(shape)
        there[at, column] = 1.0
        i, j = np.nonzero(np.triu(there @ there.T, 1))
        out = {"expert": pdf["expert"].iloc[0], "a": slides[i], "b": slides[j]}
        for c in ("v", "r"):
            x = np.zeros(shape)
            x[at, column] = pdf[c].to_numpy()
            one, two, both = x @ there.T, (x * x) @ there.T, x @ x.T
            values = (there @ there.T, one, one.T, two, two.T, both)
            out |= {f"{c}_{k}": m[i, j] for k, m in zip(SUMS, values)}
        return pd.DataFrame(out)

    types = dict(known.dtypes)
    schema = f"expert {types['expert']}, a {types['slide']}, b {types['slide']}, " + ", ".join(f"{k} double" for k in kinds)
    total = dealt.groupBy("expert", "_block").applyInPandas(sums, schema).groupBy("expert", "a", "b").agg(*[F.sum(k).alias(k) for k in kinds])

    def correlation(c: str) -> Column:
        return st.pearson_of_sums(*[F.col(f"{c}_{k}") for k in SUMS])

    return total.select("expert", "a", "b", correlation("v").alias("pearson"), correlation("r").alias("spearman"), F.col("v_n").cast("long").alias("n"))


def profile_similarity(scores: DataFrame, expert: str, concept: str, score: str) -> DataFrame:
    """(a, b, pearson) of mean profiles of every two experts."""
    mean = scores.groupBy(F.col(expert).alias("expert"), F.col(concept).alias("concept")).agg(F.avg(score).alias("v"))
    return ordered_pairs(mean, ["concept"], "expert", ["v"]).groupBy("a", "b").agg(st.pearson(F.col("v_a"), F.col("v_b")).alias("pearson"))


def global_table(scores: DataFrame, expert: str, slide: str, concept: str, score: str, weights: DataFrame | None = None, top: int = 10, digits: int = 9) -> DataFrame:
    """Per (expert, concept): mean, sd, median, min, max over slides, slides in whose
    top list it is, weighted mean, and the rank by mean and by weighted mean.

    ``weights`` has slide and w; without it every slide weighs 1.
    """
    s = scores.select(F.col(expert).alias("expert"), F.col(slide).alias("slide"), F.col(concept).alias("concept"), F.col(score).cast("double").alias("v"))
    s = s.join(weights.select(F.col(slide).alias("slide"), "w"), "slide") if weights is not None else s.withColumn("w", F.lit(1.0))
    s = ranking.ranked(s, ["expert", "slide"], [F.desc("v"), F.col("concept")], "_r")
    g = s.groupBy("expert", "concept").agg(
        F.round(F.avg("v"), digits).alias("mean"), F.round(st.sample_sd(F.col("v")), digits).alias("sd"), F.round(F.median("v"), digits).alias("median"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.count_if(F.col("_r") <= top).alias("n_top"), F.round(st.weighted_mean(F.col("v"), F.col("w")), digits).alias("weighted"),
    )
    g = ranking.ranked(g, ["expert"], [F.desc("mean"), F.col("concept")], "rank_mean")
    return g.withColumn("rank_weighted", F.row_number().over(Window.partitionBy("expert").orderBy(F.desc_nulls_last("weighted"), "concept")))


def filtered_ranking(scores: DataFrame, excluded: DataFrame, expert: str, slide: str, concept: str, score: str, top: int) -> DataFrame:
    """The top concepts of each expert after excluded ones are gone and ranks are anew."""
    left = scores.join(excluded.select(concept), concept, "left_anti")
    return global_table(left, expert, slide, concept, score).where(F.col("rank_mean") <= top)


def top_two(logits: Column) -> tuple[Column, Column]:
    """0-based places of the largest and the second largest entry; the earlier of equal ones first."""
    keyed = F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("m"), i.alias("i"))))
    return F.get(keyed, F.lit(0)).i, F.get(keyed, F.lit(1)).i


def strata_ranking(scores: DataFrame, strata: list[str], concept: str, score: str, digits: int = 9) -> DataFrame:
    """(strata, concept, mean, rank): concepts by their mean score within each stratum, ties by concept."""
    mean = scores.groupBy(*strata, concept).agg(F.round(F.avg(score), digits).alias("mean"))
    return ranking.spread_rank(mean, strata, [F.desc("mean"), F.col(concept)])


def better_than_mean(runs: DataFrame, method: str, seed: str, value: str) -> DataFrame:
    """(method, seed, mean): methods whose mean is below that of all runs, with their first seed."""
    per = runs.groupBy(F.col(method).alias("method")).agg(F.min(seed).alias("seed"), F.avg(value).alias("mean"), F.sum(value).alias("_s"), F.count(value).alias("_n"))
    whole = per.agg((F.sum("_s") / F.sum("_n")).alias("_all"))  # one row
    return per.join(F.broadcast(whole)).where(F.col("mean") < F.col("_all")).select("method", "seed", "mean")


def route(rows: DataFrame, keys: list[str], logits: str, top: int = 2) -> DataFrame:
    """Per key and expert: mean and deviation of the routing weight, top-1 and top-k
    share, ever and always among the top k, over contexts (rows)."""
    p = rows.withColumn("_p", vx.softmax(F.col(logits))).withColumn("_w", vx.top_k_softmax(F.col(logits), top))
    first = F.array_position("_p", F.array_max("_p")) - 1
    long = p.select(*keys, first.alias("_first"), F.posexplode(F.arrays_zip("_p", "_w")).alias("expert", "z"))
    inside = (F.col("z._w") > 0).cast("double")
    return long.groupBy(*keys, "expert").agg(
        F.avg("z._p").alias("prob"), F.avg("z._w").alias("weight"), F.stddev_pop("z._w").alias("weight_sd"), F.avg((F.col("_first") == F.col("expert")).cast("double")).alias("top1"),
        F.avg(inside).alias("topk"), (F.max(inside) > 0).alias("ever"), (F.min(inside) == 1).alias("always"),
    )


def reconcile(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """One row: how many keys agree within the tolerance, differ, or lack a partner."""
    x, y = a.select(*key, F.col(value).alias("_x")), b.select(*key, F.col(value).alias("_y"))
    both = x.join(y, key, "full")
    return both.agg(
        F.count_if(F.abs(F.col("_x") - F.col("_y")) < tolerance).alias("agree"), F.count_if(F.abs(F.col("_x") - F.col("_y")) >= tolerance).alias("differ"), F.count_if(F.col("_x").isNull() | F.col("_y").isNull()).alias("alone")
    )
