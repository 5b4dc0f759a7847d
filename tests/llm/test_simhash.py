import random

import numpy as np
import xxhash

from strataloom.llm import simhash as sh


def brute_print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def brute_classes(items, distance=3):
    """(id, print) pairs to smallest reachable id."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, p) in enumerate(items):
        for b, q in items[i + 1 :]:
            if (p ^ q).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {a: find(a) for a, _ in items}


TEXTS = [None, "", " \n", "one", "ONE", "one two", "a b c", "A b C", "É é", "é é", "x " * 700, "a b c d " * 300, "tab\tx\x0by\x1cz w"]


def test_fingerprints():
    assert [int(x) for x in sh.fingerprints(TEXTS)] == [brute_print(t) for t in TEXTS]
    assert len(sh.fingerprints([])) == 0


def test_masks_cover_all_close_pairs():
    rng = random.Random(2)
    masks = sh.block_masks()
    assert len(masks) == 20 and all(30 <= m.bit_count() <= 34 for m in masks)
    for _ in range(300):
        x = rng.getrandbits(64)
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        hit = [m for m in masks if not flips & m]
        assert hit
        # Within a large key the finer masks keep the pair together too.
        assert any(not flips & s for s in sh.sub_masks(hit[0]))
        assert all(64 - s.bit_count() <= 13 for s in sh.sub_masks(hit[0])), x


def test_stars_are_the_groups():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    m = {b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in (0, 1, 2, 3, 4, 6) for _ in range(20)}
    want = brute_classes([(x, x) for x in sorted(m)])
    got = {x: x for x in m}
    for a, s in sh.stars(np.array(sorted(m), dtype=np.uint64)):
        got[a] = s
    assert got == want


def test_links_with_split_keys(spark):
    """A tiny group size forces the finer cut; components stay those of brute force."""
    rng = random.Random(4)
    x = rng.getrandbits(64)
    prints = {x}
    for _ in range(150):  # a chain of near prints that all share keys
        x ^= (1 << rng.randrange(16)) | (1 << rng.randrange(16))
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(50)} | {0}
    items = [(p, p) for p in sorted(prints)]
    df = spark.createDataFrame([(sh._signed(p),) for p in prints], "fp long")
    from strataloom.operators.components import components

    for group in (3, 4096):
        found = {r.node: r.label for r in components(sh.links(df, group=group)).collect()}
        classes = {}
        for p, c in brute_classes(items).items():
            classes.setdefault(c, set()).add(sh._signed(p))
        for members in classes.values():
            labels = {found.get(p, p) for p in members}
            assert labels == {min(members)}


def near(text, rng):
    w = text.split()
    w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


def test_near_duplicates_and_drop(spark, make_docs):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(400)) for _ in range(8)]
    texts = base + [near(t, rng) for t in base] + [base[0]] * 30 + [None, "", " "]
    docs = make_docs(texts, extra=True)
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(docs).collect()}
    assert got == brute_classes([(i, brute_print(t)) for i, t in enumerate(texts)])
    kept = sh.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_edges_of_the_contract(spark, make_docs):
    assert sh.near_duplicates(make_docs([])).count() == 0
    assert sh.drop_near_duplicates(make_docs([])).count() == 0
    twice = make_docs(["same text here now", "other words stand here"])
    twice = twice.unionByName(twice)
    assert sh.near_duplicates(twice).count() == 4
    assert sorted(r.doc_id for r in sh.drop_near_duplicates(twice).collect()) == [0, 1]
    from pyspark.sql import functions as F

    void = make_docs(["p q r", "p q r", "s t u"]).withColumn("doc_id", F.when(F.col("doc_id") == 1, 7))
    assert sh.drop_near_duplicates(void).count() == 2
