"""Rates, caches, paged services and publications."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from strataloom.sources import cache, files, paged, publication, remote
from strataloom.sources.rate import TokenBucket, shares


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds
        self.slept += seconds


def test_bucket_paces_and_bursts():
    clock = Clock()
    bucket = TokenBucket(10, 3, clock, clock.sleep)
    times = []
    for _ in range(8):
        bucket.acquire()
        times.append(clock())
    assert times[:3] == [0.0] * 3 and all(abs(b - a - 0.1) < 1e-6 for a, b in zip(times[2:], times[3:]))
    clock.now += 100  # idle time gives no more than the burst
    assert sum(bucket.acquire() is None and clock() <= times[-1] + 100 for _ in range(5)) == 3
    for bad in ((0, 1), (1, 0.5)):
        with pytest.raises(ValueError):
            TokenBucket(*bad)


@pytest.mark.parametrize("rate,burst,tasks", [(10, 4, 9), (3, 1, 8), (7, 16, 5), (100, 8, 8)])
def test_no_window_is_above_the_rate(rate, burst, tasks):
    n, each, own = shares(rate, burst, tasks)
    assert n <= min(tasks, burst)
    times = []
    for k in range(n):
        clock = Clock()
        clock.now = 0.37 * k
        bucket = TokenBucket(each, own, clock, clock.sleep)
        for i in range(40):
            clock.now += 2.0 if i in (10, 25) else 0.0
            bucket.acquire()
            times.append(clock())
    times.sort()
    for i, a in enumerate(times):
        for j in range(i, len(times)):
            assert j - i + 1 <= burst + rate * (times[j] - a) + 1e-6


def test_rate_bounds_the_tasks(spark):
    requests = spark.range(24).select(F.lit("/x").alias("path"), F.create_map(F.lit("i"), F.col("id").cast("string")).alias("params"))

    def ask(path, params):
        return 200, f"{params['i']} {time.time()}"

    rows = remote.fetch(requests, ask, rate=20.0, burst=2).collect()
    times = sorted(float(r.body.split()[1]) for r in rows)
    assert len({r.body.split()[0] for r in rows}) == 24 and times[-1] - times[0] > 0.8


def requests(spark, ids, secret="s"):
    params = F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("api_key"), F.lit(secret))
    return spark.createDataFrame([(i,) for i in ids], "id int").select("id", F.lit("/a").alias("path"), params.alias("params"))


def replies():
    """Fetchers as closures, which travel to workers that cannot import this module."""

    def reply(path, params):
        if params["id"] == "5":
            return 200, "<ERROR>too many requests</ERROR>"
        return (503, "") if params["id"] == "4" else (200, f"body {params['id']}")

    def refuse(path, params):
        raise OSError("asked")

    return reply, refuse


def test_read_through(spark, tmp_path):
    reply, refuse = replies()
    kept = cache.ResponseCache(f"file://{tmp_path}/c", ["api_key"])
    first = {r.id: r for r in kept.through(requests(spark, [1, 2, 2, 4, 5]), reply, attempts=1).collect()}
    assert {i: (r.status, r.body, r.asked) for i, r in first.items()} == {1: (200, "body 1", True), 2: (200, "body 2", True), 4: (503, "", True), 5: (200, "<ERROR>too many requests</ERROR>", True)}
    # Another secret is the same request; errors were not kept.
    again = kept.through(requests(spark, [1, 2], "other"), refuse).collect()
    assert sorted((r.id, r.body, r.asked) for r in again) == [(1, "body 1", False), (2, "body 2", False)]
    assert [tuple(r) for r in kept.stats(spark).collect()] == [(2, 12)]
    assert all("api_key" not in r.params for r in kept.entries(spark).collect())
    folders = {p.name for p in (tmp_path / "c").glob("run=*/prefix=*")}
    assert folders and all(len(f) == len("prefix=ab") for f in folders)
    kept.invalidate(requests(spark, [1]))
    assert kept.entries(spark).count() == 1
    assert {r.id: r.asked for r in kept.through(requests(spark, [1, 2]), reply).collect()} == {1: True, 2: False}
    kept.compact(spark)
    assert len(list((tmp_path / "c").glob("run=*"))) == 1 and kept.entries(spark).count() == 2
    none = cache.ResponseCache(f"file://{tmp_path}/none")
    assert none.entries(spark).count() == 0 and none.stats(spark).first().bytes == 0


def test_runs_at_once_leave_one_whole_entry(spark, tmp_path):
    kept = cache.ResponseCache(f"file://{tmp_path}/c")

    def run(n):
        kept.through(requests(spark, range(20)), lambda p, q: (200, f"{n} " + q["id"] * 50)).count()

    threads = [threading.Thread(target=run, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = kept.entries(spark).collect()
    assert len(rows) == 20 and all(r.body.split()[1] == r.params["id"] * 50 for r in rows)


def test_no_parameters_are_like_null_ones(spark):
    kept = cache.ResponseCache("x")
    df = spark.createDataFrame([("/a", None), ("/a", {})], "path string, params map<string,string>")
    assert len({r.k for r in df.select(kept.key(F.col("path"), F.col("params")).alias("k")).collect()}) == 1


def test_paged_service(spark):
    paged.register(spark)
    roots = json.dumps([[str(i), f"/classes/{i}/children", {}] for i in range(4)])
    fetcher = "strataloom.plans.runs:ontology_replies"
    df = spark.read.format(paged.NAME).options(fetcher=fetcher, roots=roots).load()
    got = sorted((r.root, r.page, json.loads(r.item)["prefLabel"]) for r in df.collect())
    assert got == [(str(i), k // 3 + 1, f"class {i} {k}") for i in range(4) for k in range(2 * i + 1)]
    assert {r.root for r in df.where("root in ('1', '3')").collect()} == {"1", "3"}
    one = df.where("root = '2'")
    assert one.count() == 5 and one.rdd.getNumPartitions() == 1
    options = {"fetcher": "strataloom.plans.runs:article_replies", "path": "/fetch", "total": "23", "size": "5", "batches": "2", "rate": "500", "burst": "3"}
    search = spark.read.format(paged.NAME).options(**options).load()
    assert sorted((r.page, r.item.count("<PMID>")) for r in search.collect()) == [(1, 5), (2, 5), (3, 5), (4, 5), (5, 3)]
    with pytest.raises(Exception, match="burst"):
        spark.read.format(paged.NAME).options(fetcher=fetcher, roots=roots, rate="5", burst="2").load().collect()


def test_a_publisher_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    assert publication.publish(spark.range(3), path) == 1
    steps = ["_hashes", "_create", "rename"]
    for step in steps:
        with monkeypatch.context() as m:
            if step == "rename":
                real = files.write_text

                def write(s, p, text):
                    real(s, p, text)
                    if "/versions/" in p:
                        raise KeyboardInterrupt

                m.setattr(files, "write_text", write)
            else:
                m.setattr(publication, step, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                publication.publish(spark.range(9), path)
        assert publication.read(spark, path).count() == 3 and publication.latest(spark, path) == 1
    with pytest.raises(publication.VersionConflict):  # the last one had claimed its number
        publication.publish(spark.range(4), path)
    publication.release(spark, path)
    assert publication.publish(spark.range(4), path, expected=1) == 2
    assert publication.read(spark, path).count() == 4 and publication.read(spark, path, 1).count() == 3
    with pytest.raises(publication.VersionConflict):
        publication.publish(spark.range(5), path, expected=1)
    with pytest.raises(FileNotFoundError):
        publication.read(spark, f"file://{tmp_path}/none")


def test_manifest_tells_changed_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    publication.publish(spark.range(10).repartition(3), path)
    assert publication.mismatches(spark, path).count() == 0 and publication.current(spark, path)["files"] == 3
    parts = sorted(tmp_path.glob("t/data/*/table/*.parquet"))
    parts[0].unlink()
    parts[1].write_bytes(b"x")
    for crc in tmp_path.glob("t/data/*/table/.*.crc"):
        crc.unlink()
    got = {r.name: r.problem for r in publication.mismatches(spark, path).collect()}
    assert got == {parts[0].name: "missing", parts[1].name: "changed"}
