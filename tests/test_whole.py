"""Queries over whole tables against brute force."""

from strataloom.plans import catalog


def run(spark, name, folder, **tables):
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return catalog.queries()[name](spark, str(folder)).collect()


def test_spatial_knn_all(spark, tmp_path):
    events = [(i, i * 37 % 500, "ab"[i % 2]) for i in range(400, 800)]
    df = spark.createDataFrame(events, "event_id long, user_id long, event_type string")
    points = [(g, i, i * 7919 % 1009, u * 104729 % 997) for i, u, g in events]
    want = set()
    for g, i, x, y in points:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for h, j, a, b in points if h == g and j != i)[:5]
        want |= {(g, i, j, float(d), r) for r, (d, j) in enumerate(near, 1)}
    rows = run(spark, "j13_spatial_knn", tmp_path, events=df)
    assert len(rows) == len(want)
    assert {(r["group"], r["id"], r["neighbour"], r["d2"], r["rank"]) for r in rows} == want


def test_merge_predicate_all(spark, tmp_path):
    parts = [(i, ["red ring", "hot bolt"][i % 2], i * 7 % 30, f"Brand#{i * 5 % 23}", ["SMALL", "LARGE", "ECONOMY"][i % 3]) for i in range(250, 420)]
    df = spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_brand string, p_type string")
    parts += [(500 + i, *parts[i][1:]) for i in range(20)]  # copies
    df = spark.createDataFrame(parts, df.schema)
    want = dict.fromkeys((p[0] for p in parts), 0)
    for i, name, size, brand, kind in parts:
        for j, name2, size2, brand2, kind2 in parts:
            x, y = {kind, brand, name.split()[0]}, {kind2, brand2, name2.split()[0]}
            both = brand.startswith("Brand#1") and brand2.startswith("Brand#1")
            if i != j and name == name2 and abs(size - size2) <= 10 and (not both or len(x & y) / len(x | y) >= 0.4):
                want[i] += 1
    rows = run(spark, "p04_merge_predicate", tmp_path, part=df)
    assert len(rows) == len(want) and {r["p_partkey"]: r["n_links"] for r in rows} == want
    assert all(r["class"] == min(p[0] for p in parts if p[1:] == next(x[1:] for x in parts if x[0] == r["p_partkey"])) for r in rows)


def test_bank_diff_all(spark, tmp_path):
    import hashlib

    head = "the same twelve letters "
    docs = [(0, head + "a", "en", "src4"), (1, head + "B", "de", "src5"), (2, head + "b", "de", "src6"), (3, head + "c", "en", "src18"), (4, head + "C", "fr", "src19"), (5, "", "en", "other")]
    rows = run(spark, "t04_bank_diff", tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    key = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {(key(head + "a"), "lost", "en", None), (key(head + "c"), "changed", "en", "fr"), (key(""), "lost", "en", None)}
    assert {tuple(r) for r in rows} == want


def test_set_difference_all(spark, tmp_path):
    docs, labels = spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id long"), spark.createDataFrame([(i,) for i in (3, 4, 5)], "doc_id long")
    rows = run(spark, "t03_set_difference", tmp_path, documents=docs, labels=labels)
    assert {tuple(r) for r in rows} == {(1, "extra"), (2, "extra"), (4, "missing"), (5, "missing")}


def test_mentions_all(spark, tmp_path):
    filler = " ".join(f"w{i}" for i in range(150))
    docs = [(0, f"{filler} Late", "en", "src1"), (1, f"late {filler}  LATE", "en", "src0"), (2, "x late", "en", "src1"), (3, "Late", "en", "src2"), (4, "late", "fr", "src3")]
    rows = run(spark, "a11_mentions", tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    # Late and late are as frequent and as long; Late at word 151 of document 0 comes before document 1.
    assert [tuple(r[c] for c in ("k", "lang", "n", "label", "forms", "ids", "queries")) for r in rows] == [("late", "en", 5, "Late", 3, "0,1,2,3", "src0,src1,src2")]


def test_pick_canonical_all(spark, tmp_path):
    head = "twenty equal letters "
    docs = [(0, head + "and a long end", "src3", 100), (1, head + "short", "src3", 100), (2, "x", "src1", 100), (3, head + "b", "src1", 101), (4, head + "a", "src2", 101)]
    rows = run(spark, "a09_pick_canonical", tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long"))
    assert {tuple(r) for r in rows} == {(0, 1, head + "short"), (1, 3, head + "b")}
