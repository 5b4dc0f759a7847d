"""Clusters of similar vectors by average linkage.

Clusters whose average similarity reaches a threshold can only merge if some
pair of them reaches it, so every average-linkage cluster lies within one
connected component of the pairs at that threshold.  Components are found by
blocked products and star steps over the whole table.  Small ones are merged in
one task each; in larger ones all clusters that are each other's nearest merge
at once, round by round.  Average linkage is reducible (a merged cluster is no
nearer to a third than the nearer of its two was), so both give the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..storage import stored
from . import joins as jo
from .components import components
from .density import ends

#: Clusters of a component that are merged in one task: their similarities take 32 MB.
IN_TASK = 2_000


def merge_average(vectors: np.ndarray, weights: np.ndarray, least: float) -> np.ndarray:
    """A cluster number per unit vector: the closest two clusters merge while their
    average similarity is at least ``least``; ``weights`` are copies of a vector.

    The average over pairs of two clusters is the product of their mean vectors.
    """
    n = len(vectors)
    cluster, alive = np.arange(n), np.ones(n, dtype=bool)
    mean, size = vectors.astype(np.float64).copy(), weights.astype(np.float64).copy()
    sim = mean @ mean.T
    np.fill_diagonal(sim, -np.inf)
    best, at = sim.max(axis=1), sim.argmax(axis=1)  # each cluster's nearest one
    while best.max() >= least - 1e-12:
        i = int(best.argmax())
        i, j = sorted((i, int(at[i])))
        cluster[cluster == j] = i
        mean[i] = (mean[i] * size[i] + mean[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        row = mean @ mean[i]
        row[~alive] = row[i] = -np.inf
        sim[j, :] = sim[:, j] = best[j] = -np.inf
        sim[i, :] = sim[:, i] = row
        stale = np.append(np.flatnonzero(alive & ((at == i) | (at == j))), i)
        best[stale], at[stale] = sim[stale].max(axis=1), sim[stale].argmax(axis=1)
        closer = row > best
        best[closer], at[closer] = row[closer], i
    return cluster


def nearest(clusters: DataFrame) -> DataFrame:
    """(rep, sim, lo, hi): the nearest other cluster of the part for each of (rep, part, v, n).

    ``v`` is the mean of the cluster's unit vectors, so the product of two is the
    average similarity.  Equal similarities are ordered by the pair's ids.
    """
    side = clusters.select(F.col("rep").alias("id"), F.col("part").cast("string").alias("g"), F.lit("").alias("a"), "v")

    def search(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        same = p["i"].iloc[0] == p["j"].iloc[0]
        p, q = (t.sort_values("id", kind="stable") for t in (p, q))
        ids = [t["id"].to_numpy() for t in (p, q)]
        x, y = (np.array([np.asarray(v) for v in t["v"]]) for t in (p, q))
        best, to = [np.full(len(t), -np.inf) for t in ids], [np.zeros(len(t), dtype=np.int64) for t in ids]
        strip = max(1, jo.TILE // 8)
        for i in range(0, len(x), strip):
            # Of one block with itself, the pairs below the diagonal are those above it.
            for j in range(i // jo.TILE * jo.TILE if same else 0, len(y), jo.TILE):
                r, c = slice(i, i + strip), slice(j, j + jo.TILE)
                sim = x[r] @ y[c].T
                if same and j <= i:
                    sim[ids[0][r, None] >= ids[1][None, c]] = -np.inf
                for side, here, axis, first in ((0, r, 1, j), (1, c, 0, i)):
                    at = sim.argmax(axis=axis)
                    top = np.take_along_axis(sim, np.expand_dims(at, axis), axis).squeeze(axis)
                    new = top > best[side][here]
                    best[side][here] = np.where(new, top, best[side][here])
                    to[side][here] = np.where(new, at + first, to[side][here])
        out = []
        for side in (0, 1):
            k = np.flatnonzero(np.isfinite(best[side]))
            a, b = ids[side][k], ids[1 - side][to[side][k]]
            out.append(pd.DataFrame({"rep": a, "sim": best[side][k], "lo": np.minimum(a, b), "hi": np.maximum(a, b)}))
        return pd.concat(out)

    found = jo._blocked(side, side, search, "rep long, sim double, lo long, hi long", jo.BLOCK, half=True)
    return found.groupBy("rep").agg(F.min(F.struct((-F.col("sim")).alias("less"), "lo", "hi")).alias("e")).select("rep", (-F.col("e.less")).alias("sim"), "e.lo", "e.hi")


def merged(clusters: DataFrame, near: DataFrame) -> DataFrame:
    """(rep, other, part, v, n): clusters that are each other's nearest as one, ``other`` its second; those nearest to one that
    is nearer to a third as they are; those without a near one are done.

    A pair is named by at most its two clusters, so they meet in one small group.
    """
    c = F.array_sort(F.collect_list(F.struct("rep", "part", "n", "v"))).alias("c")
    both = clusters.join(near.select("rep", "lo", "hi"), "rep").groupBy("lo", "hi").agg(c).select(F.col("c")[0].alias("a"), F.get("c", F.lit(1)).alias("b"))
    n = F.col("a.n") + F.coalesce("b.n", F.lit(0))
    mean = F.zip_with("a.v", "b.v", lambda x, y: (x * F.col("a.n") + y * F.col("b.n")) / n)
    return both.select("a.rep", F.col("b.rep").alias("other"), "a.part", F.when(F.col("b").isNull(), F.col("a.v")).otherwise(mean).alias("v"), n.alias("n"))


def average_linkage(df: DataFrame, key: str, vector: str, least: float, group: str | None = None, in_task: int = IN_TASK) -> DataFrame:
    """(id, cluster): clusters of rows, named by their smallest id.

    The two closest clusters merge while their average cosine similarity is at
    least ``least``; rows of different groups never meet.  Equal vectors are one
    with a weight, so copies neither cost nor change anything.  Components of
    more than ``in_task`` distinct vectors merge in rounds until they are that
    small, with the same result.  Rows with a null vector, group or id have no
    row in the result; a zero vector is a cluster of its own.
    """
    if not least > 0:
        raise ValueError("least must be above 0")
    own = df.select(
        F.col(key).cast("long").alias("id"), (F.col(group) if group else F.lit("")).cast("string").alias("g"), vx.normalize(F.col(vector)).alias("u")
    ).where("id is not null and g is not null and u is not null")
    # Rounded, so that copies computed in another order are copies; named by the smallest id.
    distinct = own.groupBy("g", F.transform("u", lambda x: F.round(x, 12)).alias("v")).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    distinct = stored(distinct, "distinct-vectors")
    found = components(jo.threshold_stars(distinct, least - 1e-9, "rep", "v", group="g"))
    # Tables of a row a node are merged: by the size of their files Spark would broadcast them whole.
    live = distinct.join(found.select(F.col("node").alias("rep"), F.col("label").alias("part")).hint("merge"), "rep").select("rep", "part", "v", "n")
    live = stored(live.withColumn("turn", F.lit(0)), "clusters")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        number = merge_average(np.array([np.asarray(v) for v in pdf["v"]]), pdf["n"].to_numpy(), least)
        reps = pdf["rep"].to_numpy()
        return pd.DataFrame({"node": reps, "target": reps[number]}).query("node != target")

    turns = [live]
    while True:
        sizes = live.groupBy("part").agg(F.count("*").alias("m"))
        large = stored(live.join(sizes.where(F.col("m") > in_task), "part").select("rep", "part", "v", "n"), "clusters")
        if large.isEmpty():
            break
        paired = merged(large, nearest(large).where(F.col("sim") >= least - 1e-12)).withColumn("turn", F.lit(len(turns)))
        turns.append(stored(paired, "merged"))
        live = turns[-1].select("rep", "part", "v", "n")
    # All rounds are read as one table: a plan with branches for each would take memory of the driver by their number.
    files = [f for t in turns for f in t.inputFiles()]
    every = df.sparkSession.read.schema("rep long, other long, part long, v array<double>, n long, turn int").parquet(*files)
    # A component is small in one turn, its last.  There are at most a large one in ``in_task`` rows.
    large = every.groupBy("turn", "part").agg(F.count("*").alias("m")).where(F.col("m") > in_task).select("turn", "part")
    small = every.join(F.broadcast(large) if in_task >= IN_TASK else large, ["turn", "part"], "left_anti").select("rep", "part", "v", "n")
    links = small.groupBy("part").applyInPandas(run, "node long, target long")
    links = links.unionByName(every.where("other is not null").select(F.col("other").alias("node"), F.col("rep").alias("target")))
    named = distinct.select("g", "v", "rep")
    named = named.join(ends(links).withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("g", "v", F.coalesce("target", "rep").alias("cluster"))
    rows = own.select("id", "g", F.transform("u", lambda x: F.round(x, 12)).alias("v"))
    return rows.join(named, ["g", "v"]).select("id", "cluster")
