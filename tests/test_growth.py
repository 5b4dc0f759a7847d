"""What larger tables showed: plans that must not broadcast, ids and sums at size, and bounded tasks."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataloom.operators import aggregates
from strataloom.operators import joins as jo
from strataloom.operators import ranking
from strataloom.operators.components import components
from strataloom.plans import catalog


def run(spark, name, folder, **tables):
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return catalog.queries()[name](spark, str(folder))


def test_merge_predicate_does_not_broadcast(spark, tmp_path):
    parts = [(i, ["red ring", "hot bolt"][i % 2], i % 30, f"Brand#{i % 23}", "SMALL") for i in range(100)]
    df = run(spark, "p04_merge_predicate", tmp_path, part=spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_brand string, p_type string"))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def against_sql(spark, name, folder, **tables):
    """The query's rows, and those of its SQL on the same tables by one thread."""
    df = run(spark, name, folder, **tables)
    db = duckdb.connect()
    db.sql("set threads = 1")
    for table in tables:
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = db.sql(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in df.collect()), sorted(want)


def many_parts(spark):
    row = [F.col("id").alias("p_partkey"), F.lit("hot ring").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("SMALL").alias("p_type")]
    return spark.range(100_050).select(*row)


def test_minted_ids_of_six_digits(spark, tmp_path):
    rows, want = against_sql(spark, "w09_mint_ids", tmp_path, part=many_parts(spark))
    assert rows == want


def test_canonical_ids_of_six_digits(spark, tmp_path):
    rows, want = against_sql(spark, "c08_canonicalise", tmp_path, part=many_parts(spark))
    assert rows == want


def split_events(spark):
    """Events in two files: added up in order, the small values of users 1 and 3 are lost in the large first one."""
    values = {1: [1e16, 1.0, 1.0, 1.0], 2: [1e16, 0.0, 0.0, 0.0], 3: [1e16, 0.5, 0.5, 0.5, *[0.0] * 45, -1e16]}
    rows = [(i, u, "click", v) for u, x in values.items() for i, v in enumerate(x)]
    files = [[r for r in rows if (r[0] == 0) == at_first] for at_first in (True, False)]
    first, rest = (spark.createDataFrame(f, "event_id long, user_id long, event_type string, value double").coalesce(1) for f in files)
    return first.unionByName(rest)


def split_against_sql(spark, name, folder):
    split_events(spark).write.parquet(f"{folder}/events.parquet")
    df = catalog.queries()[name](spark, str(folder))
    db = duckdb.connect()
    db.sql("set threads = 1")
    db.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = db.sql(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_share_rank_of_several_files(spark, tmp_path):
    split_against_sql(spark, "a30_share_rank", tmp_path)


def test_reported_recomputed_of_several_files(spark, tmp_path):
    split_against_sql(spark, "d16_reported_recomputed", tmp_path)


def out_of_order_against_sql(spark, name, folder, seed, users):
    """Two files whose rows do not follow event_id, which also repeats; values such that another order of adding gives other last digits."""
    rng = np.random.default_rng(seed)
    n = 6000
    rows = pd.DataFrame({"event_id": rng.permutation(n) // 2, "user_id": rng.integers(0, users, n), "event_type": rng.choice(["click", "error", "view"], n), "value": np.round(rng.gamma(1, 40, n), 2)})
    # A user's copy, whose rows come in another order, has the same sums but for last digits.
    rows = pd.concat([rows, rows.sample(frac=1, random_state=seed).assign(user_id=lambda r: r.user_id + users)])
    (folder / "events.parquet").mkdir()
    for file, part in (("part-1", rows[:5000]), ("part-0", rows[5000:])):
        part.to_parquet(f"{folder}/events.parquet/{file}.parquet", index=False, row_group_size=700)
    df = catalog.queries()[name](spark, str(folder))
    db = duckdb.connect()
    db.sql("set threads = 1")
    db.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = db.sql(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_share_rank_adds_in_the_order_of_the_table(spark, tmp_path):
    out_of_order_against_sql(spark, "a30_share_rank", tmp_path, 9, 30)


def test_reported_recomputed_adds_in_the_order_of_the_table(spark, tmp_path):
    out_of_order_against_sql(spark, "d16_reported_recomputed", tmp_path, 2, 800)


def test_paged_scan_asks_every_root(spark, tmp_path):
    rows, want = against_sql(spark, "s17_paged_scan", tmp_path, region=spark.createDataFrame([(i,) for i in range(4)], "r_regionkey int"))
    assert rows == want and {r[0] for r in rows} == {"0", "1", "2", "3"}


def test_best_of_tiles_is_that_of_a_full_sort():
    rng = np.random.default_rng(5)
    sim = rng.integers(0, 6, (40, 90)) / 5.0  # many ties
    sim[rng.random(sim.shape) < 0.3] = -np.inf
    sim[:3] = -np.inf
    sim[1, 70] = 0.2
    for k in (1, 4, 100):
        best = None
        for first in range(0, 90, 30):
            best = jo._best(k, sim[:, first : first + 30], first, best)
        for r in range(40):
            want = [(sim[r, c], c) for c in sorted(np.flatnonzero(np.isfinite(sim[r])), key=lambda c: (-sim[r, c], c))[:k]]
            got = [(s, c) for s, c in zip(best[0][r], best[1][r]) if np.isfinite(s)]
            assert got == want


def test_partitions_follow_the_rows(spark):
    assert ranking.by_size(spark.range(1000), ["id"], rows=50).rdd.getNumPartitions() == 20
    assert ranking.by_size(spark.range(0), ["id"]).rdd.getNumPartitions() == 4  # the session's


@pytest.mark.parametrize("digits", [None, 2])
@pytest.mark.parametrize("differ", [None, "g"])
def test_neighbours_by_a_filter_in_single_precision(spark, monkeypatch, digits, differ):
    monkeypatch.setattr(jo, "TILE", 16)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(8)
    # Some vectors are farther apart than double precision shows, but not than single precision does.
    m = np.array([*rng.standard_normal((40, 8)), *(base + 1e-7 * rng.standard_normal((40, 8))), *[base] * 20])
    rows = [(int(i), v.tolist(), int(i) % 3) for i, v in zip(rng.permutation(1000)[: len(m)], m)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int")
    u = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    got = {}
    for r in jo.knn(df, df, 3, "id", "v", differ=differ, block=40, digits=digits).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.sim
    for i, _, g in rows:
        sims = [float(np.einsum("i,i->", u[i], u[j])) for j, _, h in rows if j != i and (differ is None or g != h)]
        want = sorted((np.floor(s * 100 + 0.5) / 100 if digits and s > 0 else s for s in sims), reverse=True)[:3]
        assert [got[i][k] for k in (1, 2, 3)] == pytest.approx(want, abs=1e-15)


def test_stars_link_what_double_precision_links(spark, monkeypatch):
    monkeypatch.setattr(jo, "TILE", 16)
    rng = np.random.default_rng(6)
    angles = np.concatenate((rng.uniform(0, 3, 60), [4.0, 4.1, 4.1 + 1e-9]))
    rows = [(int(i), [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(angles)]
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    least = float(np.einsum("i,i->", u[60], u[61]))  # reached by this pair and not by the next one
    want = np.arange(len(u))
    for _ in range(len(u)):
        want = np.array([min(want[j] for j in range(len(u)) if np.einsum("i,i->", u[i], u[j]) >= least) for i in range(len(u))])
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for block in (10, 1000):
        found = {r.node: r.label for r in components(jo.threshold_stars(df, least, "id", "v", block=block)).collect()}
        assert [found.get(i, i) for i in range(len(u))] == want.tolist()


@pytest.mark.parametrize("search", ["knn", "stars"])
def test_few_pairs_are_multiplied_in_double(spark, monkeypatch, search):
    rng = np.random.default_rng(7)
    x = pd.DataFrame({"id": range(6000), "a": "", "v": list(rng.standard_normal((6000, 64))), "i": 0, "j": 0})
    found, products, pairs = [], jo._products, []
    monkeypatch.setattr(jo, "_blocked", lambda left, right, run, *_, **__: found.append(run) or left.selectExpr("id", "id neighbour", "1.0D sim"))
    monkeypatch.setattr(jo, "_products", lambda p, q, i, j: pairs.append(len(i)) or products(p, q, i, j))
    df = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    jo.knn(df, df, 5, "id", "v") if search == "knn" else jo.threshold_stars(df, 0.5, "id", "v")
    found[0](x, x)
    assert 0 < len(pairs) and sum(pairs) < len(x) ** 2 / 50


def test_spatial_neighbours_of_many_points_at_few_places(spark):
    rng = np.random.default_rng(8)
    place = np.array([*rng.integers(0, 3, (4000, 2)), *rng.integers(0, 500, (60, 2)), *(200 + rng.random((300, 2)) / 100)], dtype=float)
    rows = [(int(i), "a" if n % 2 else "b", float(x), float(y)) for n, (i, (x, y)) in enumerate(zip(rng.permutation(len(place)), place))]
    df = spark.createDataFrame([*rows, (9001, "c", 0.0, 0.0), (9002, "a", None, 1.0)], "id long, g string, x double, y double")
    got = {}
    found = jo.spatial_knn(df, 3, None, "id", "g")
    for r in found.collect():
        got.setdefault(r.id, []).append((r["rank"], r.d2, r.neighbour))
    for g in "ab":
        ids, xy = np.array([r[0] for r in rows if r[1] == g]), np.array([r[2:] for r in rows if r[1] == g])
        for i, at in zip(ids.tolist(), xy):
            d2 = (xy[:, 0] - at[0]) ** 2 + (xy[:, 1] - at[1]) ** 2
            d2[ids == i] = np.inf
            best = np.lexsort((ids, d2))[:3]
            assert sorted(got[i]) == [(n + 1, d2[b], ids[b]) for n, b in enumerate(best)]
    assert set(got) == {r[0] for r in rows}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()  # pairs are ranked where they are made


def test_tiles_in_double_are_strips():
    x = pd.DataFrame({"v": list(np.eye(3000, 4) + 1)})
    tiles = list(jo._tiles(x, x))
    assert max(sim.nbytes for _, _, sim in tiles) <= 4 << 20
    assert sum(sim.size for _, _, sim in tiles) == 3000**2


def test_mentions_are_combined_where_they_are_read(spark, tmp_path, monkeypatch):
    """What a11 stores grows with the forms, not with forms times documents; later documents of frequent words are left out exactly."""
    kept, keep = {}, aggregates.stored

    def stored(df, name):
        kept[name] = keep(df, name)
        return kept[name]

    monkeypatch.setattr(aggregates, "stored", stored)
    monkeypatch.setattr(aggregates, "FREQUENT", 7)
    docs = [(i, " ".join([*(f"w{j}" if (i + j) % 3 else f"W{j}" for j in range(i % 4, 20)), f"x{i // 6}", f"x{i // 6}"]), "en", f"src{i % 12}") for i in range(60)]
    docs += [(2**63 - 1, "edge x0 X0", "en", "src1"), (-(2**63), "X0 Edge EDGE edge edge", "en", "src1"), (-5, "", "en", "src2"), (7000, None, "en", "src2")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    rows, want = against_sql(spark, "a11_mentions", tmp_path, documents=df)
    assert rows == want and len(rows) == 31
    assert kept["mentions"].count() < 20 * 12 * 2 + 40  # by document: over 1,100


@pytest.mark.parametrize("kind", ["string", "long"])
def test_mentions_of_any_key(spark, kind):
    """Documents named by strings, positions that are longs, null documents and no queries."""
    rows = [(None if i == 3 else i % 25 + 10, i, "Aa" if i % 2 else "aA", "aa", "t") for i in range(80)]
    df = spark.createDataFrame(rows, "doc long, position long, form string, k string, tier string").withColumn("doc", F.col("doc").cast(kind))
    (r,) = aggregates.mentions(df, "form", "k", "tier", "doc", "position", 5, 4).collect()
    ids = [10, 11, 12]  # a null document is the first and is not named
    assert (r.n, r.label, list(r.synonyms), r.forms) == (80, "Aa", ["aA"], 2) and [int(x) for x in r.doc_ids] == ids
