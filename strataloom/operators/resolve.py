"""Entity resolution, filtering against references, matching of banks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..storage import discard, stored
from . import joins as jo
from . import ranking, sets
from .components import components


def resolve(df: DataFrame, key: str, vector: str, tier: str, least: float, mergeable=None) -> DataFrame:
    """(id, cluster): clusters of rows of a tier that similarity links.

    Links are pairs with cosine similarity of at least ``least`` for which
    ``mergeable(left, right)`` holds (two row aliases of ``df``); clusters are
    their connected components, named by the smallest id.  This is single
    linkage at a fixed threshold.
    """
    if mergeable is None:  # only the components of the links matter
        edges = jo.threshold_stars(df, least, key, vector, group=tier)
    else:
        a, b = df.alias("left"), df.alias("right")
        edges = jo.threshold_pairs(df, df, least, key, vector, group=tier, unordered=True)
        edges = edges.join(a, F.col("a") == F.col(f"left.{key}")).join(b, F.col("b") == F.col(f"right.{key}")).where(mergeable)
        edges = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = components(edges)
    own = df.select(F.col(key).cast("long").alias("node"))
    return own.join(found, "node", "left").select(F.col("node").alias("id"), F.coalesce("label", "node").alias("cluster"))


def dedup(
    df: DataFrame, key: str, vector: str, tier: str, label: str, synonyms: str, definition: str, source: str, genes: str, least: float,
    overlap: float = 0.5, priority: Sequence[str] = (), prefix: str = "", split: Column | None = None, clusters: DataFrame | None = None,
) -> DataFrame:
    """(cluster, id, label, synonyms, definition, size): one merged concept per cluster.

    Rows of a tier are clustered (``clusters`` has id and cluster; by default
    average linkage at ``least``).  Where ``split`` holds, only pairs of a cluster
    stay together that are similar enough and, if both have genes and sources
    that begin with ``prefix``, overlap by ``overlap``; a cluster falls into the
    components of such pairs.  The canonical row has the first source of
    ``priority``, then the shortest label, then the smallest id; the others'
    labels and synonyms become its own, and the longest definition stays.
    Equal vectors with equal genes of one kind of source are one row when pairs
    are made.  Rows with a null vector or tier have no cluster and no row here.
    """
    from . import aggregates as ag
    from .cluster import average_linkage

    found = clusters if clusters is not None else average_linkage(df, key, vector, least, tier)
    own = df.join(found.select(F.col("id").alias(key), F.col("cluster").alias("_cluster")), key)
    if split is not None:
        parted = own.where(split).select(
            F.col(key).alias("_id"), "_cluster", F.transform(vx.normalize(F.col(vector)), lambda x: F.round(x, 12)).alias("_v"),
            F.col(source).startswith(prefix).alias("_own"), F.array_sort(F.array_distinct(F.coalesce(genes, F.array().cast("array<string>")))).alias("_genes"),
        )
        kinds = ["_cluster", "_v", "_own", "_genes"]
        classes = stored(parted.groupBy(*kinds).agg(F.min("_id").alias("_rep")), "classes")
        both = F.col("left._own") & F.col("right._own") & (F.size("left._genes") > 0) & (F.size("right._genes") > 0)
        joined = resolve(classes, "_rep", "_v", "_cluster", least, ~both | (sets.jaccard(F.col("left._genes"), F.col("right._genes")) >= overlap))
        parts = parted.join(classes.join(joined.select(F.col("id").alias("_rep"), F.col("cluster").alias("_part")), "_rep"), kinds).select(F.col("_id").alias(key), "_part")
        own = own.join(parts, key, "left").withColumn("_cluster", F.coalesce("_part", "_cluster")).drop("_part")
    own = stored(own, "clustered")
    merged = ag.merge_cluster(own, "_cluster", key, label, synonyms, definition, ag.pick_canonical(own, "_cluster", key, label, source, list(priority)))
    sizes = own.groupBy("_cluster").agg(F.count("*").alias("size"))
    return merged.join(sizes, "_cluster").withColumnRenamed("_cluster", "cluster")


def reference_scores(df: DataFrame, key: str, vector: str, tier: str, centroids: DataFrame, negatives: DataFrame, reference: DataFrame, k: int, ref_key: str, ref_tier: str) -> DataFrame:
    """Adds score (cosine with the own tier's centroid), negative (name and sim of the
    nearest negative centroid), agreement (share of the k nearest references of the own tier)."""
    with_neg = jo.max_similarity(df, negatives, vector).withColumnRenamed("name", "negative_name").withColumnRenamed("sim", "negative")
    scored = with_neg.join(centroids.select(F.col(tier), F.col("centroid")), tier, "left").withColumn("score", vx.cosine(F.col(vector), F.col("centroid"))).drop("centroid")
    near = jo.knn(df, reference, k, key, vector, ref_key, vector)
    tiers = reference.select(F.col(ref_key).cast("long").alias("neighbour"), F.col(ref_tier).alias("_t"))
    own = df.select(F.col(key).cast("long").alias("id"), F.col(tier).alias("_own"))
    share = near.join(tiers, "neighbour").join(own, "id").groupBy("id").agg(F.avg((F.col("_t") == F.col("_own")).cast("double")).alias("agreement"))
    return scored.join(share, F.col(key) == F.col("id"), "left").drop("id").withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))


def calibrate(reference: DataFrame, key: str, vector: str, tier: str, negatives: DataFrame, p: float, gap: float, default_keep: float, default_drop: float) -> DataFrame:
    """(tier, keep, drop, fallback): thresholds from a labelled reference.

    keep is the ``p`` percentile of the similarities to the own centroid; drop is
    the mean similarity to the nearest negative.  Where keep does not exceed
    drop by ``gap`` the classes do not separate, and the defaults hold.
    """
    c = vx.centroid(reference, tier, vector)
    own = jo.max_similarity(reference.join(c, tier), negatives, vector).select(tier, vx.cosine(F.col(vector), F.col("centroid")).alias("own"), "sim")
    own = stored(own, "calibration")
    per = ranking._with(own.groupBy(tier).agg(F.avg("sim").alias("d")), ranking.quantiles(own, [tier], "own", {"k": p}), [tier])
    bad = F.col("k") < F.col("d") + F.lit(gap)
    return per.select(tier, F.when(bad, default_keep).otherwise(F.col("k")).alias("keep"), F.when(bad, default_drop).otherwise(F.col("d")).alias("drop"), bad.alias("fallback"))


def thresholds(tiers: DataFrame, tier: str, saved: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """(tier, one column a default): saved thresholds per tier, a default for each that is missing.

    Saved tiers that are not among ``tiers`` are an error when the query runs, so
    a misspelt one does not pass for a default.
    """
    own = tiers.select(tier).distinct().withColumn("_known", F.lit(True))
    both = own.join(saved, tier, "full")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("thresholds of an unknown tier: "), F.col(tier).cast("string"))).cast("double"))
    return both.select(tier, *[F.coalesce(checked, F.col(n).cast("double") if n in saved.columns else F.lit(None), F.lit(float(v))).alias(n) for n, v in defaults.items()])


def revote(df: DataFrame, reference: DataFrame, key: str, vector: str, tier: str, k: int, floor: float) -> DataFrame:
    """(id, tier, top_sim, votes, new_tier): majority of the k nearest references.

    A tier wins with more than half of k votes if the nearest reference is at
    least ``floor`` similar; otherwise the old tier stays.
    """
    near = jo.knn(df, reference, k, key, vector)
    labels = reference.select(F.col(key).cast("long").alias("neighbour"), F.col(tier).alias("label"))
    won = jo.vote(near, labels).join(near.where("rank = 1").select("id", F.col("sim").alias("top_sim")), "id")
    own = df.select(F.col(key).cast("long").alias("id"), F.col(tier).alias("tier"))
    new = F.when((F.col("votes") >= k // 2 + 1) & (F.col("top_sim") >= floor), F.col("winner")).otherwise(F.col("tier"))
    return own.join(won, "id", "left").select("id", "tier", "top_sim", "votes", F.coalesce(new, "tier").alias("new_tier"))


def adjudicate(df: DataFrame, key: str, decision: str, decisions: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Adds verdict: external decisions merged into the ambiguous and the probed rows.

    ``decisions`` has the key, ``answer`` (JSON text with a field ``keep``) and
    ``attempt``; the first attempt that parses counts.  A row that was asked and
    has no answer that parses is dropped; rows that were not asked keep what
    their decision says.
    """
    parsed = decisions.select(key, "attempt", F.from_json("answer", "struct<keep:boolean>").keep.alias("keep")).where("keep is not null")
    first = parsed.groupBy(key).agg(F.min_by("keep", "attempt").alias("_keep"))
    out = df.join(first, key, "left")
    if probes is not None:
        out = out.join(probes.select(key).distinct().withColumn("_probe", F.lit(True)), key, "left")
    else:
        out = out.withColumn("_probe", F.lit(False))
    asked = (F.col(decision) == "ambiguous") | F.coalesce("_probe", F.lit(False))
    verdict = F.when(asked, F.when(F.col("_keep"), "keep").otherwise("drop")).otherwise(F.when(F.col(decision) == "keep", "keep").otherwise("drop"))
    return out.withColumn("verdict", verdict).drop("_keep", "_probe")


def without_adjudicator(df: DataFrame, decision: str, fail: bool = False) -> DataFrame:
    """What is left when nothing can be asked: ambiguous rows go, the rest is marked skipped.

    ``fail`` makes that an error instead.  Rows with a null decision stay.
    """
    if fail:
        raise RuntimeError("the adjudicator cannot be reached")
    left = df.where(~F.coalesce(F.col(decision) == "ambiguous", F.lit(False)))
    return left.withColumns({"answer": F.lit("skipped"), "confidence": F.lit("skipped"), "reason": F.lit(""), "probe": F.lit(False)})


def _decided(edges: DataFrame) -> DataFrame:
    """(a, b, sim): edges of the greedy matching that one round tells.

    An edge that is the best of both its ends is in it.  An edge that only one
    better edge touches is in it if that one is not; such edges hang on each
    other in chains, and every step follows twice as long a part of them.
    """
    order = [F.desc("sim"), F.desc("a"), F.desc("b")]
    two_a = edges.withColumn("ra", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where("ra <= 2")
    two_b = edges.withColumn("rb", F.row_number().over(Window.partitionBy("b").orderBy(*order))).where("rb <= 2")
    two_a, two_b = stored(two_a, "match"), stored(two_b, "match")
    near = stored(two_a.join(two_b.select("a", "b", "rb"), ["a", "b"]), "match")
    sure = near.where("ra = 1 and rb = 1").select("a", "b", "sim")
    first_a, first_b = two_a.where("ra = 1").select("a", F.col("b").alias("pb")), two_b.where("rb = 1").select("b", F.col("a").alias("pa"))
    second_a = near.where("ra = 2 and rb = 1").join(first_a, "a").select("a", "b", "sim", F.col("a").alias("pa"), "pb")
    second_b = near.where("ra = 1 and rb = 2").join(first_b, "b").select("a", "b", "sim", "pa", F.col("b").alias("pb"))
    way = stored(second_a.unionByName(second_b).withColumn("odd", F.lit(True)), "match")
    while True:
        ahead = way.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("odd").alias("more"))
        more = F.col("more").isNotNull()
        new = stored(way.join(ahead, ["pa", "pb"], "left").select(
            "a", "b", "sim", F.coalesce("qa", "pa").alias("pa"), F.coalesce("qb", "pb").alias("pb"), F.when(more, F.col("odd") != F.col("more")).otherwise(F.col("odd")).alias("odd"), more.alias("moved"),
        ), "match")
        discard(way)
        way = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    hung = way.where("not odd").join(sure.select(F.col("a").alias("pa"), F.col("b").alias("pb")), ["pa", "pb"], "left_semi")
    return stored(sure.unionByName(hung.select("a", "b", "sim")), "match")


def greedy_match(pairs: DataFrame, left: str = "a", right: str = "b", sim: str = "sim") -> DataFrame:
    """One-to-one matching that sequential greedy by (sim, a, b) descending finds.

    In each round all edges are taken that ``_decided`` tells, and their ends'
    other edges go.  The order is strict, so the matching is the greedy one
    (Preis, 1999).  Of repeated pairs the best counts; nulls match nothing.
    """
    own = pairs.select(F.col(left).alias("a"), F.col(right).alias("b"), F.col(sim).alias("sim")).where("a is not null and b is not null and sim is not null")
    edges = stored(own.groupBy("a", "b").agg(F.max("sim").alias("sim")), "match")
    taken = None
    while not edges.isEmpty():
        won = _decided(edges)
        rest = stored(edges.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti"), "match")
        discard(edges)
        edges = rest
        taken = won if taken is None else taken.unionByName(won)
    return taken.select("a", "b", "sim") if taken is not None else edges


def two_phase_match(left: DataFrame, right: DataFrame, key: str, vector: str, tier: str, within: float, across: float, digits: int | None = None) -> DataFrame:
    """(a, b, sim, phase): greedy within tiers, then across tiers among the rest.

    ``digits`` rounds similarities before they are compared.
    """
    def pairs(x, y, **kw):
        p = jo.threshold_pairs(x, y, kw.pop("least"), key, vector, **kw)
        return p.withColumn("sim", F.round("sim", digits)) if digits is not None else p

    first = greedy_match(pairs(left, right, least=within, group=tier)).withColumn("phase", F.lit("within"))
    x = left.join(first, F.col(key) == F.col("a"), "left_anti")
    y = right.join(first, F.col(key) == F.col("b"), "left_anti")
    second = greedy_match(pairs(x, y, least=across, differ=tier)).withColumn("phase", F.lit("across"))
    return first.unionByName(second)


def merge_banks(reference: DataFrame, candidates: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """All concepts of both banks with status matched, reference_only or novel."""
    a = reference.join(matches.select(F.col("a").alias(key), F.lit(True).alias("_m")), key, "left")
    b = candidates.join(matches.select(F.col("b").alias(key), F.lit(True).alias("_m")), key, "left")
    a = a.withColumn("status", F.when(F.col("_m"), "matched").otherwise("reference_only"))
    b = b.withColumn("status", F.when(F.col("_m"), "matched").otherwise("novel"))
    return a.drop("_m").withColumn("bank", F.lit("reference")).unionByName(b.drop("_m").withColumn("bank", F.lit("candidate")))
