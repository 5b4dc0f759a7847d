import math
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from strataloom.llm import sharding as sg


def test_weights_and_growth(spark):
    ids = spark.range(40_000).withColumn("t", F.lit("x"))
    heavy = sg.tree(8, weights={0: 3.0, 5: 0.0})
    got = {r.shard: r["count"] for r in sg.assign(ids, heavy, doc_id="id", text="t").groupBy("shard").count().collect()}
    assert 5 not in got and abs(got[0] / sum(got.values()) - 0.3333) < 0.02
    rows = sg.assign(ids, sg.tree(16), sg.grow(sg.tree(16)), doc_id="id", text="t")
    moved = rows.where("shard <> grown_shard").groupBy("grown_shard").count().collect()
    assert [r.grown_shard for r in moved] == [16] and abs(moved[0]["count"] / 40_000 - 1 / 17) < 0.01


def test_change_stays_in_its_subtree(spark):
    ids = spark.range(20_000).withColumn("t", F.lit("x"))
    rows = sg.assign(ids, sg.tree(16), sg.tree(16, weights={3: 0.25}), doc_id="id", text="t").where("shard <> grown_shard")
    # Every row that moves was under the region whose weight fell.
    assert {r.shard // 4 for r in rows.select("shard").distinct().collect()} == {0}


def test_slots_sizes_and_nulls(spark, make_docs):
    texts = [None, "", "é", "same", "same"] * 300
    docs = make_docs(texts, extra=True)
    docs = docs.unionByName(docs.where("doc_id < 50")).withColumn("doc_id", F.when(F.col("doc_id") % 97 != 0, F.col("doc_id")))
    rows = sg.assign(docs, sg.tree(16), lists=7).collect()
    assert len(rows) == 1550
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        t = (texts[r.doc_id] or "") if r.doc_id is not None else None
        if t is not None:
            assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sg.assign(make_docs([]), sg.tree(4)).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 6, 16])
def test_any_growth_moves_rows_only_into_the_new_shard(spark, shards):
    ids = spark.range(6_000).withColumn("t", F.lit("x"))
    now = sg.tree(shards)
    for new in range(shards, shards + 3):
        grown = sg.grow(now)
        assert sg.shards_of(grown) == list(range(new + 1))
        rows = sg.assign(ids, now, grown, doc_id="id", text="t").where("shard <> grown_shard").groupBy("grown_shard").count().collect()
        assert [r.grown_shard for r in rows] == [new] and abs(rows[0]["count"] / 6_000 - 1 / (new + 1)) < 0.05
        now = grown


def descend(key, node, path=""):
    """The shard of a key by plain recursion."""
    while isinstance(node, dict):
        draws = []
        for name, child in node.items():
            w = sg.weight(child)
            if w > 0:
                h = xxhash64(key, f"{path}/{name}")
                draws.append((-math.log(((h >> 11) + 1) / (2**53 + 1)) / w, name))
        _, name = min(draws)
        path, node, shard = f"{path}/{name}", node[name], name
    return shard


def xxhash64(*strings):
    """Spark's hash of several strings: each is hashed with the hash before as seed."""
    h = 42
    for s in strings:
        h = xxhash.xxh64_intdigest(s.encode(), h)
    return h


def test_descent_and_slots_by_brute_force(spark):
    """Shards by recursion; slots by sorting; the same slots for other splits of the input."""
    weights = {0: 3.0, 2: 0.5, 5: 0.0, 9: 2.0}
    rows = [(i % 700 if i % 50 else None, "x" * (i % 13)) for i in range(2000)] + [(7, "copy")] * 300
    results = []
    for n in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        for copies in (20, 10_000):
            got = sg.assign(df, sg.tree(11, weights=weights), lists=5, copies=copies).collect()
            results.append(sorted((str(r.doc_id), r.size, r.shard, r.slot) for r in got))
    assert all(r == results[0] for r in results) and len(results[0]) == len(rows)
    for i, _, shard, _ in results[0]:
        assert shard == descend("\x00null" if i == "None" else i, sg.tree(11, weights=weights))
    for shard in {r[2] for r in results[0]}:
        mine = sorted(r[3] for r in results[0] if r[2] == shard)
        assert mine == list(range(len(mine)))


def test_a_thousand_shards(spark):
    rows = sg.assign(spark.range(5_000).withColumn("t", F.lit("x")), sg.tree(1000), doc_id="id", text="t").groupBy("shard").count().collect()
    assert len(rows) > 900 and max(r["count"] for r in rows) < 25


def test_query_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in sg.op9_sharding(spark, "/root/testdata/sf0.001").collect()}
    now, grown = sg.tree(16), sg.grow(sg.tree(16))
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        raw = (d.text or "").encode()
        assert (r.shard, r.grown_shard) == (descend(str(d.doc_id), now), descend(str(d.doc_id), grown)) and r.law == "key"
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.grown_shard in (r.shard, 16)
    for shard in range(16):
        assert sorted(r.slot for r in rows.values() if r.shard == shard) == list(range(sum(r.shard == shard for r in rows.values())))
