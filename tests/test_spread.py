"""Ranks, quantiles, pair percentiles and links of whole tables against brute force; paged and failing sources."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import aggregates, joins, ranking
from strataloom.sources import remote, runs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    groups = ["hot"] * 200 + ["a", "b", None] * 12
    return [(i, g, rng.choice([None, 0.0, 1.5, -2.0, rng.random(), rng.random()])) for i, g in enumerate(groups)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(5)


def test_positions_and_ranks(df, rows):
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert {r.id: r.position for r in ranking.positions(df, [F.col("v"), F.col("id")]).collect()} == {r[0]: i for i, r in enumerate(order)}
    got = {r.id: r["rank"] for r in ranking.spread_rank(df, ["g"], [F.col("v"), F.col("id")]).collect()}
    tied = {r.id: r["rank"] for r in ranking.spread_tied_rank(df, ["g"], "v").collect()}
    assert len(got) == len(tied) == len(rows)
    for g in {r[1] for r in rows}:
        mine = [r for r in order if r[1] == g]
        assert [got[r[0]] for r in mine] == list(range(1, len(mine) + 1))
        for r in mine:
            places = [i for i, x in enumerate(mine, 1) if x[2] == r[2]]
            assert tied[r[0]] == sum(places) / len(places)
    assert ranking.spread_rank(df.limit(0), ["g"], [F.col("id")]).count() == 0


def test_quantiles(df, rows):
    shares = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    extra = df.unionByName(df.sparkSession.createDataFrame([(999, "void", None)], df.schema))
    got = {r.g: r for r in ranking.quantiles(extra, ["g"], "v", shares).collect()}
    assert set(got) == {"hot", "a", "b", None, "void"} and got["void"].q2 is None
    for g in ("hot", "a", "b", None):
        values = [v for _, x, v in rows if x == g and v is not None]
        for name, q in shares.items():
            assert math.isclose(got[g][name], np.quantile(values, q), abs_tol=1e-12)


def test_quantiles_by_narrowing_and_by_wrong_sketches(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([np.zeros(3000), rng.standard_normal(3000), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    shares = {"a": 0.01, "b": 0.49, "c": 0.5, "d": 0.777}
    for options in ({"most": 50}, {"margin": 1e-6}, {}):
        got = ranking.quantiles(df, [], "v", shares, **options).first()
        assert all(math.isclose(got[n], np.quantile(values, q), abs_tol=1e-12) for n, q in shares.items())


def test_a_value_that_most_rows_share_is_no_range(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.rand(3)).alias("v"))
    got = ranking.spread_tied_rank(rows, [], "v")
    assert got.where("v = 0").agg(F.min("rank"), F.max("rank")).first()[:] == (9000.5, 9000.5)
    counts = rows.groupBy("v").agg(F.count("*").alias("n"))
    totals = {r.v: r.before for r in ranking.running_total(counts, ["v"], "n", "before").collect()}
    assert totals[0.0] == 0 and sorted(totals.values())[1] == 18_000 and max(totals.values()) == 19_999


def test_pairwise_percentile(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((60, 5))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(m)] + [(90, 7, m[0].tolist())], "id long, g int, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for block in (7, 1000):
        monkeypatch.setattr(joins._each_pair, "__defaults__", (block,))
        got = {r.g: (r.p, r.n_pairs) for r in aggregates.pairwise_percentile(df, "g", "id", "v", 0.3).collect()}
        assert set(got) == {0, 1}
        for g in (0, 1):
            mine = u[g::2]
            sims = (mine @ mine.T)[np.triu_indices(len(mine), 1)]
            assert math.isclose(got[g][0], np.quantile(sims, 0.3), abs_tol=1e-9) and got[g][1] == len(sims)


def test_leaks(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("xyz"), rng.choice([None, "a", "b", "c", "d"]), rng.choice(["p", "q"])) for i in range(80)] + [(200, "x", "only", "p"), (201, "x", "only", "p")]
    df = spark.createDataFrame(rows, "id long, split string, t string, k string")
    want = set()
    for i, s, t, k in rows:
        same = [r for r in rows if r[2:] == (t, k) and t is not None]
        if n := sum(r[1] != s for r in same):
            want.add((i, s, min(r[0] for r in same), n))
    assert {tuple(r) for r in joins.leaks(df, "id", "split", ["t", "k"]).collect()} == want


def flaky():
    """A fetcher of 503 at the first two tries, as told by a file that counts them."""

    def fetch(path, params):
        with open(params["log"], "a+") as f:
            f.write(".")
            f.seek(0)
            tries = len(f.read())
        return (503, "") if tries < 3 else (200, "done")

    return fetch


def test_fetch_tries_again(spark, tmp_path):
    ask = spark.createDataFrame([("/a", {"log": str(tmp_path / "a")})], remote.REQUEST)
    assert [(r.status, r.body, r.attempts) for r in remote.fetch(ask, flaky()).collect()] == [(200, "done", 3)]
    ask = spark.createDataFrame([("/b", {"log": str(tmp_path / "b")})], remote.REQUEST)
    assert [(r.status, r.attempts) for r in remote.fetch(ask, flaky(), attempts=2).collect()] == [(503, 2)]


def test_pages_in_a_circle_are_an_error(spark):
    page = json.dumps({"collection": [1], "links": {"nextPage": "http://x.example/again?page=1"}})
    roots = spark.createDataFrame([("r", "/start", {})], "root string, path string, params map<string,string>")
    with pytest.raises(Exception, match="circles"):
        remote.follow_pages(roots, lambda path, params: (200, page)).collect()


def test_batches(spark):
    ids = spark.createDataFrame([(i,) for i in range(53)] + [(None,), (7,)], "i long")
    asked = [r.params["id"].split(",") for r in remote.id_batches(ids, "i", 10, "/x", {"k": "v"}, tasks=3).collect()]
    assert sorted(int(x) for a in asked for x in a) == list(range(53)) and max(map(len, asked)) == 10
    pages = [(int(r.params["retstart"]), int(r.params["retmax"])) for r in remote.history_batches(spark, 25, 10, "/x", {}).collect()]
    assert sorted(pages) == [(0, 10), (10, 10), (20, 5)] and remote.history_batches(spark, 0, 10, "/x", {}).count() == 0


def test_sources_may_fail(spark):
    def broken():
        raise OSError("down")

    with pytest.raises(OSError):
        runs.run_sources(spark, [("a", True, broken)], "x string", skip_errors=False)
    rows, failures = runs.run_sources(spark, [("a", True, broken)], "x string")
    assert rows.count() == 0 and rows.columns == ["x"] and [tuple(r) for r in failures.collect()] == [("a", "OSError", "down")]


def test_a_failure_of_the_session_is_not_one_of_a_source(spark):
    def full():
        raise MemoryError

    with pytest.raises(MemoryError):
        runs.run_sources(spark, [("a", True, full)], "x string")


def test_list_file(spark, tmp_path):
    (tmp_path / "l.yaml").write_text("# top\nnames:\n  - A1\n  - 'B: 2'  # note\n\n- \"c\"\nplain\n")
    assert [r.item for r in runs.read_list(spark, f"file://{tmp_path}/l.yaml").orderBy("position").collect()] == ["A1", "B: 2", "c", "plain"]


def test_run_record(spark, tmp_path):
    assert runs.RunRecord("x", {}, "abc", True).values["revision"] == "abc"
    r = runs.RunRecord("x", {"b": 1, "a": "é"})
    out = r.finish(spark, f"file://{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == out and out["revision"] is None and not out["dirty"]
    assert runs.config_hash({"a": "é", "b": 1}) == out["config_hash"]
