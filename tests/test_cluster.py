"""Average linkage, stars of links and linear vector expressions against brute force."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import vectors as vx
from strataloom.operators import cluster, components as steps, density, joins, profiles
from strataloom.operators.components import components


def naive(m, least):
    """Merge the two clusters of the largest average similarity, by all pairs, until it is below the threshold."""
    sim, groups = m @ m.T, [[i] for i in range(len(m))]
    while len(groups) > 1:
        best = max(((sim[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] < least - 1e-12:
            break
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def rows(seed, n=40, dim=3):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    m[n - 5 :] = m[:5]  # copies
    return m


@pytest.mark.parametrize("seed,least", [(0, 0.9), (1, 0.7), (2, 0.97)])
def test_average_linkage(spark, seed, least):
    m = rows(seed)
    data = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(m)] + [(100, None, "a"), (101, [0.0] * 3, "a"), (102, [1.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(data, "id long, v array<double>, g string").repartition(4)
    got = {}
    for r in cluster.average_linkage(df, "id", "v", least, "g").collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert all(c == min(ids) for c, ids in got.items())
    want = {frozenset({101})}
    for g in range(2):
        ids = [i for i in range(len(m)) if i % 2 == g]
        want |= {frozenset(ids[x] for x in c) for c in naive(m[ids], least)}
    assert {frozenset(x) for x in got.values()} == want
    assert cluster.average_linkage(df.limit(0), "id", "v", least, "g").count() == 0


@pytest.mark.parametrize("in_task", [0, 6])
def test_rounds_give_what_one_task_gives(spark, in_task):
    v = [[float(np.cos(x)), float(np.sin(x))] for x in np.random.default_rng(4).uniform(0, 6, 40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v array<double>")
    for least in (0.95,):
        want = {tuple(r) for r in cluster.average_linkage(df, "id", "v", least).collect()}
        assert {tuple(r) for r in cluster.average_linkage(df, "id", "v", least, in_task=in_task).collect()} == want
        groups = {}
        for i, c in want:
            groups.setdefault(c, set()).add(i)
        assert {frozenset(x) for x in groups.values()} == naive(np.array(v), least)


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_stars_have_the_components_of_all_pairs(spark, block):
    m = rows(3, 60, 4)
    df = spark.createDataFrame([(i * 7 % 61, v.tolist(), "ab"[i % 3 == 0]) for i, v in enumerate(m)], "id long, v array<double>, g string")
    pairs = joins.threshold_pairs(df, df, 0.8, "id", "v", group="g", unordered=True, block=block).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    stars = joins.threshold_stars(df, 0.8, "id", "v", group="g", block=block)
    want, got = ({(r.node, r.label) for r in components(e).collect()} for e in (pairs, stars))
    assert got == want and want


def test_small_groups_are_one_block(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0], str(i // 2)) for i in range(200)], "id long, v array<double>, g string")
    got = joins.knn(df, df, 1, "id", "v", group="g", block=4).collect()
    assert sorted((r.id, r.neighbour) for r in got) == [(i, i ^ 1) for i in range(200)]


def test_vector_expressions_take_linear_time(spark):
    df = spark.range(2000).select("id", F.transform(F.sequence(F.lit(1), F.lit(512)), lambda i: F.sin(i * F.col("id")) + 0.5).alias("v")).coalesce(4).cache()
    df.count()
    for f in (vx.normalize, vx.softmax, lambda v: vx.top_k_softmax(v, 2)):
        began = time.time()
        df.select(f(F.col("v")).alias("x")).write.format("noop").mode("overwrite").save()
        assert time.time() - began < 8  # 48 s when a norm was computed for every element
    got = df.where("id in (3, 4)").select("v", vx.normalize(F.col("v")).alias("n"), vx.softmax(F.col("v")).alias("s"), vx.top_k_softmax(F.col("v"), 3).alias("t")).collect()
    for r in got:
        v = np.array(r.v)
        e = np.exp(v - v.max())
        top = np.where(np.isin(np.arange(512), np.lexsort((np.arange(512), -v))[:3]), e, 0)
        assert np.allclose(r.n, v / np.linalg.norm(v)) and np.allclose(r.s, e / e.sum()) and np.allclose(r.t, top / top.sum())
    df.unpersist()


def test_profiles_in_blocks(spark, monkeypatch):
    m = rows(5, 30, 4)
    df = spark.createDataFrame([(i, i % 6, float(i % 7), v.tolist()) for i, v in enumerate(m)], "id long, g long, s double, v array<double>")
    concepts = df.select(F.col("id").alias("c"), "v")
    results = []
    for size, broadcast in ((256, 4096), (2, 0)):
        monkeypatch.setattr(profiles, "PROFILES", size)
        monkeypatch.setattr(profiles, "BROADCAST_PROFILES", broadcast)
        out = profiles.contrastive_scores(df, "g", "s", "id", "v", concepts, "c", 2)
        results.append(sorted((r.g, r.c, round(r.score, 6), r["rank"]) for r in out.collect()))
    assert results[0] == results[1] and len(results[0]) == 180


def test_many_centroids_are_a_table(spark):
    m = rows(6, 40, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "id long, v array<double>")
    named = spark.createDataFrame([(f"n{i:02}", v.tolist()) for i, v in enumerate(rows(7, 12, 3))], "name string, centroid array<double>")
    for digits in (None, 3, 1):
        few, many = ({r.id: (r.name, r.sim and round(r.sim, 9)) for r in joins.max_similarity(df, named, "v", digits, literals=n).collect()} for n in (1000, 5))
        assert few == many and len(few) == 41 and few[99] == (None, None)


def test_rounding_comes_before_the_comparison(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    named = spark.createDataFrame([("a", [0.99990, 0.01414]), ("b", [1.0, 0.0001])], "name string, centroid array<double>")
    assert {joins.max_similarity(df, named, "v", 3, literals=n).first().name for n in (100, 0)} == {"a"}
    assert {joins.max_similarity(df, named, "v", literals=n).first().name for n in (100, 0)} == {"b"}
    assert joins.max_similarity(df, named.limit(0), "v").first().name is None


def test_nearest_over_several_tiles(spark):
    """More rows than a tile has, in two parts, with equal similarities."""
    rng = np.random.default_rng(8)
    v = rng.integers(-3, 4, (4_600, 6)).astype(float)  # small integers: products are exact and often equal
    part = (np.arange(len(v)) % 23 == 0).astype(int)
    df = spark.createDataFrame([(i, int(p), x.tolist(), 1) for i, (x, p) in enumerate(zip(v, part))], "rep long, part long, v array<double>, n long")
    got = {r.rep: (r.sim, r.lo, r.hi) for r in cluster.nearest(df).collect()}
    assert len(got) == len(v)
    for p in (0, 1):
        ids = np.flatnonzero(part == p)
        for i in ids[:: max(1, len(ids) // 150)]:
            sim = v[ids] @ v[i]
            sim[ids == i] = -np.inf
            best = min((min(i, j), max(i, j)) for j in ids[sim == sim.max()])
            assert got[i] == (sim.max(), *best)


def test_rounds_write_little(spark, monkeypatch):
    """A round of merging writes the clusters of large components and what they become, nothing else, and no row a dimension."""
    names, rows, keep = [], [], cluster.stored

    def stored(df, name):
        names.append(name)
        df = keep(df, name)
        rows.append(df.count())
        return df

    monkeypatch.setattr(cluster, "stored", stored)
    v = [[float(np.cos(x)), float(np.sin(x))] for x in np.random.default_rng(4).uniform(0, 6, 40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v array<double>")
    assert len({r.cluster for r in cluster.average_linkage(df, "id", "v", 0.95, in_task=0).collect()}) < 20
    assert names[:2] == ["distinct-vectors", "clusters"] and set(names[2::2]) == {"clusters"} and set(names[3::2]) == {"merged"}
    assert rows[2:] == sorted(rows[2:], reverse=True)
    small = spark.createDataFrame([(1, 7, 2, [1.0, 0.0]), (2, 7, 1, [0.0, 1.0]), (3, 7, 1, [0.5, 0.0]), (4, 7, 1, [0.0, 0.0])], "rep long, part long, n long, v array<double>")
    near = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 1, 3)], "rep long, lo long, hi long")
    out = cluster.merged(small, near)
    assert {(r.rep, r.other, r.n, *np.round(r.v, 9)) for r in out.collect()} == {(1, 2, 3, 0.666666667, 0.333333333), (3, None, 1, 0.5, 0.0)}
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_average_linkage_broadcasts_no_table_of_nodes(spark, monkeypatch):
    """What has a row a node, or a row a link, is merged; the files of many ids are small enough to be broadcast."""
    plans = []

    def watched(keep):
        def stored(df, name, *rows):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return keep(df, name, *rows)

        return stored

    for module in (cluster, steps, density):
        monkeypatch.setattr(module, "stored", watched(module.stored))
    monkeypatch.setattr(steps, "BROADCAST_EDGES", 10)
    v = [[float(np.cos(x)), float(np.sin(x))] for x in np.random.default_rng(4).uniform(0, 6, 40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v array<double>")
    out = cluster.average_linkage(df, "id", "v", 0.95, in_task=6)
    assert {n for n, _ in plans} == {"distinct-vectors", "edges", "clusters", "merged", "links"}
    plans = [p for n, p in plans if n != "merged"] + [out._jdf.queryExecution().executedPlan().toString()]
    assert not [p for p in plans if re.search(r"BroadcastHashJoin \[(src|rep|target)#", p)]
    assert sum(bool(re.search(r"SortMergeJoin \[(src|rep|target)#", p)) for p in plans) >= 4
    groups = {}
    for i, c in out.collect():
        groups.setdefault(c, set()).add(i)
    assert {frozenset(x) for x in groups.values()} == naive(np.array(v), 0.95)


def test_plan_of_the_links_does_not_grow_with_the_rounds(spark, monkeypatch):
    plans, rounds, keep, own = [], [], density.stored, cluster.stored

    def links(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(density, "stored", links)
    monkeypatch.setattr(cluster, "stored", lambda df, name: rounds.append(name) or own(df, name))
    v = [[float(np.cos(x)), float(np.sin(x))] for x in np.random.default_rng(4).uniform(0, 6, 40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v array<double>")
    cluster.average_linkage(df, "id", "v", 0.95, in_task=1)
    assert rounds.count("merged") > 2 and plans[0].count("FlatMapGroupsInPandas") == 1 and plans[0].count("Scan parquet") <= 3
