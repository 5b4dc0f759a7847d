import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import stats as st
from strataloom.functions import text as tx
from strataloom.functions import vectors as vx
from strataloom.operators import checks as ck
from strataloom.operators import joins as jo
from strataloom.operators import lexicon, ranking, resolve, rules, sets
from strataloom.operators.components import components


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("The a x-ray", "x-ray"), ("A the cell", "the cell"), (" (Tumor  cell). ", "tumor cell"), ("12.5", None), ("of the", None), ("ab", None), (None, None)])
def test_normalize_entity(spark, raw, want):
    assert one(spark, tx.normalize_entity(F.lit(raw).cast("string"), ["of", "the", "a"])) == want


def test_synonyms(spark):
    got = one(spark, tx.clean_synonyms(F.array(*map(F.lit, (" b ", "B", "", "a", "Label", "A"))), F.lit("label")))
    assert got == ["a", "b"]
    assert one(spark, tx.sort_by_lower(F.array(*map(F.lit, ("b", "A", "a", "B"))))) == ["A", "a", "B", "b"]


def test_truncate_humanize_case(spark):
    assert one(spark, tx.truncate_sentence(F.lit("One. Two. Three words"), 12)) == "One. Two."
    assert one(spark, tx.truncate_sentence(F.lit("abcdefghij"), 4)) == "abcd"
    assert one(spark, tx.humanize(F.lit("SET_T_CELL_COUNT"))) == "T cell count"
    assert one(spark, tx.sentence_case(F.lit("cd8+ T-CELL and pd1"), ["CD", "PD"])) == "CD8+ t-cell and PD1"


def test_seed_and_errors(spark):
    import hashlib

    d = hashlib.sha256(b"7|key").digest()[:8]
    assert one(spark, tx.seed_of(7, F.lit("key"))) == int.from_bytes(d, "little") % (2**63 - 1)
    for bad in (tx.id_number(F.lit("none")), tx.map_or_fail(F.lit("x"), {"a": "b"})):
        with pytest.raises(Exception):
            one(spark, bad)


def test_vectors(spark):
    v = F.array(*map(F.lit, (3.0, 0.0, 4.0)))
    zero = F.array(*map(F.lit, (0.0, 0.0)))
    assert one(spark, vx.normalize(v)) == [0.6, 0.0, 0.8] and one(spark, vx.normalize(zero)) == [0.0, 0.0] and one(spark, vx.cosine(zero, zero)) == 0
    assert one(spark, vx.top_k_softmax(F.array(*map(F.lit, (1.0, 1.0, 1.0))), 2)) == [0.5, 0.5, 0.0]


def test_pearson_guards(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (2, 1.0, 5.0), (2, 1.0, 6.0), (3, 1.0, 1.0), (4, None, 1.0)], "g int, x double, y double")
    got = {r.g: r.r for r in df.groupBy("g").agg(st.pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: None}


def unit_rows(n, dim, seed):
    m = np.random.default_rng(seed).standard_normal((n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_blocked_joins_do_not_depend_on_blocks(spark):
    m = unit_rows(60, 8, 0)
    df = spark.createDataFrame([(i, m[i].tolist(), str(i % 3)) for i in range(60)] + [(99, None, "0")], "id long, v array<double>, g string")
    sim = m @ m.T
    for block in (7, 1000):
        got = {(r.id, r.neighbour) for r in jo.knn(df, df, 3, "id", "v", block=block).collect()}
        want = {(i, j) for i in range(60) for j in [x for x in np.argsort(-sim[i], kind="stable") if x != i][:3]}
        assert got == want
        pairs = {(r.a, r.b) for r in jo.threshold_pairs(df, df, 0.5, "id", "v", group="g", unordered=True, block=block).collect()}
        assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 == j % 3 and sim[i, j] >= 0.5}


def test_spatial_knn_widens(spark):
    rng = random.Random(1)
    points = [(i, "a", rng.random() * 100, rng.random() * 100) for i in range(50)] + [(100, "a", 5000.0, 5000.0), (200, "b", 0.0, 0.0), (201, "b", 900.0, 0.0), (300, "c", 1.0, 1.0)]
    df = spark.createDataFrame(points, "id long, g string, x double, y double")
    got = {}
    for r in jo.spatial_knn(df, 3, 5.0, "id", "g").collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    for i, g, x, y in points:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, h, a, b in points if h == g and j != i)[:3]
        assert [n for _, n in sorted(got.get(i, []))] == [j for _, j in near]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_greedy_match(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(12), rng.randrange(12)): rng.choice([0.1, 0.5, 0.5, 0.9]) for _ in range(60)}
    used_a, used_b, want = set(), set(), set()
    for s, a, b in sorted(((s, a, b) for (a, b), s in edges.items()), reverse=True):
        if a not in used_a and b not in used_b:
            want.add((a, b, s))
            used_a.add(a)
            used_b.add(b)
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, sim double")
    assert {tuple(r) for r in resolve.greedy_match(df).collect()} == want
    assert resolve.greedy_match(df.limit(0)).count() == 0


def test_a_chain_of_falling_similarities_takes_few_rounds(spark, monkeypatch):
    n, rounds = 2_000, []
    # a0-b0, a1-b0, a1-b1, a2-b1 ...: each edge waits for the one before.
    edges = [(k // 2 + k % 2, k // 2, 1.0 - k / (2 * n)) for k in range(n)]
    real = resolve._decided
    monkeypatch.setattr(resolve, "_decided", lambda e: rounds.append(1) or real(e))
    got = {(r.a, r.b) for r in resolve.greedy_match(spark.createDataFrame(edges, "a long, b long, sim double")).collect()}
    assert got == {(k, k) for k in range(n // 2)} and len(rounds) <= 2


def test_two_phase_match(spark):
    left = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [0.6, 0.8], "y")], "id long, v array<double>, t string")
    right = spark.createDataFrame([(11, [1.0, 0.0], "x"), (12, [0.6, 0.8], "x"), (13, [0.0, 1.0], "z")], "id long, v array<double>, t string")
    got = {(r.a, r.b, r.phase) for r in resolve.two_phase_match(left, right, "id", "v", "t", 0.85, 0.92).collect()}
    assert got == {(1, 11, "within"), (2, 13, "across"), (3, 12, "across")}


def test_running_best_with_patience(spark):
    rows = [("r", i, v) for i, v in enumerate([5.0, 4.95, 4.0, 4.1, None, 3.0, 9.0, 9.0, 9.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, s int, v double")
    assert [(r.step, r.since) for r in ranking.running_best(df, ["g"], "s", "v", 0.1).orderBy("step").collect()] == [(0, 0), (2, 1), (5, 1), (9, 3)]
    assert [r.step for r in ranking.running_best(df, ["g"], "s", "v", 0.1, patience=3).orderBy("step").collect()] == [0, 2, 5]


def test_gaps_and_batches(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 1), ("c", 1), ("d", 2)], "g string, n int")
    assert sorted(r.g for r in ranking.gaps(df, ["g"], "n").collect()) == ["b", "c", "d"]


def test_rules(spark):
    df = spark.createDataFrame([("t cell",), ("killer t cell x",), ("cells",), (None,)], "name string").withColumn("id", F.monotonically_increasing_id())
    aliases = spark.createDataFrame([("t cell", "T"), ("killer t cell", "K")], "alias string, value string")
    got = {r.name: r.value for r in rules.alias_normalize(df, "id", "name", aliases, "none").collect()}
    assert got == {"t cell": "T", "killer t cell x": "K", "cells": "none", None: "none"}
    d = lambda *a: one(spark, rules.decide(*map(F.lit, a)))
    assert [d(0.5, 0.1, 0.9, 0.4, 0.2, False), d(0.5, 0.6, 0.9, 0.4, 0.2, True), d(0.1, 0.0, 0.9, 0.4, 0.2, True), d(0.2, 0.0, 0.9, 0.4, 0.2, True), d(0.4, 0.0, 0.5, 0.4, 0.2, True), d(0.4, 0.0, 0.4, 0.4, 0.2, True)] == [
        "no_reference", "drop_negative", "drop_far", "ambiguous", "keep", "ambiguous",
    ]


def test_thresholds(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    cal = spark.createDataFrame([("a", 0.3)], "k string, value double")
    got = {r.k: (r.threshold, r.fallback_used) for r in rules.resolve_thresholds(df, "k", None, cal, 0.5).collect()}
    assert got == {"a": (0.3, False), "b": (0.5, True)}
    assert {r.threshold for r in rules.resolve_thresholds(df, "k", 0.9, cal, 0.5).collect()} == {0.9}


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 2.0), (2, "a", None), (3, None, float("nan"))], "k int, c string, v double")
    assert [(r.key, r.detail) for r in ck.duplicates(df, "k").collect()] == [("1", "2")]
    assert sorted(r.key for r in ck.within_range(df, "k", "v", -1, 1).collect()) == ["1", "2", "3"]
    assert sorted(r.key for r in ck.uniform(df, "k", "c").collect()) == ["1"]
    assert sorted(r.key for r in ck.complete_categories(df, "k", "c", ["a", "b"]).collect()) == ["2", "3"]
    with pytest.raises(Exception, match="duplicate"):
        ck.fail_on(ck.duplicates(df, "k")).collect()
    with pytest.raises(Exception):
        ck.required_lookup(df, df, "k", "c").select("k", "c").collect()


def test_jaccard_and_merge(spark):
    empty = F.array().cast("array<string>")
    ab, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))
    assert one(spark, sets.jaccard(empty, empty)) == 0 and one(spark, sets.jaccard(ab, b)) == 0.5
    m = lambda x, y, i, j: one(spark, sets.may_merge(F.lit(0.9), 0.8, F.lit(x), F.lit(y), "set", i, j, 0.6))
    assert (m("set1", "set2", ab, b), m("set1", "other", ab, b), m("set1", "set2", ab, empty)) == (False, True, True)


def test_adjudicate_defaults(spark):
    df = spark.createDataFrame([(1, "ambiguous"), (2, "ambiguous"), (3, "ambiguous"), (4, "keep"), (5, "drop_far"), (6, "keep")], "k int, d string")
    answers = spark.createDataFrame([(1, 1, "x"), (1, 2, '{"keep": true}'), (2, 1, "x"), (2, 2, "y"), (6, 1, '{"keep": false}')], "k int, attempt int, answer string")
    got = {r.k: r.verdict for r in resolve.adjudicate(df, "k", "d", answers, spark.createDataFrame([(6,)], "k int")).collect()}
    assert got == {1: "keep", 2: "drop", 3: "drop", 4: "keep", 5: "drop", 6: "drop"}


def test_clean_view_refuses_unknown_tier(spark):
    c = spark.createDataFrame([("X-0001", "n", "q")], "id string, name string, tier string")
    p = spark.createDataFrame([("X-0001", "human")], "id string, species string")
    with pytest.raises(Exception, match="not in mapping"):
        lexicon.clean_view(c, p, "id", "name", "tier", F.lit(False), c.limit(0), {"t": "s"}, {}).collect()
