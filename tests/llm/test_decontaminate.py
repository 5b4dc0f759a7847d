import random
import re

import pytest
from pyspark.sql import functions as F

from strataloom.llm import decontaminate as dc


def brute(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for name, item in items:
        v = split(item)
        m = min(10, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(name)
    return len(w), sorted(hit), sorted(found)


def found(spark, texts, items, **options):
    """(n_words, hit words, items) per text, by the operator."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string").repartition(2)
    rows = sorted(dc.contamination(docs, bench, "c", keep=["doc_id"], **options).collect(), key=lambda r: r.doc_id)
    return [(r.c.n_words, [i for s in r.c.spans for i in range(s.start, s.stop)], r.c["items"]) for r in rows]


@pytest.mark.parametrize("seed,bits", [(0, 28), (1, 7), (2, 28), (3, 6)])
def test_every_window_is_found(spark, seed, bits):
    """Against every window looked up at every position; also with a bit map that is full."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(4 if seed < 2 else 40)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(str(i), " ".join(words(rng.choice([0, 1, 3, 9, 10, 11, 25, 60])))) for i in range(12)]
    texts = []
    for _ in range(80):
        pieces = words(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            v = rng.choice(items)[1].split()
            a = rng.randrange(len(v) + 1)
            pieces += v[a : a + rng.choice([5, 9, 10, 12, 40])] + ["X!"] * rng.randrange(2) + words(rng.randrange(6))
        texts.append(rng.choice([" ", ", ", "\n"]).join(pieces))
    texts += [None, "", "...", "  ", texts[0], texts[1].upper()]
    assert found(spark, texts, items, most_bits=bits) == [brute(t, items) for t in texts]


def test_parts_are_cut_in_python_workers_too(monkeypatch):
    """Windows of a text in parts are those of the whole text."""
    rng = random.Random(4)
    raw = dc.plain(" ".join(rng.choice(["a", "bb", "c" * 30]) for _ in range(600)))
    everything = lambda h: h == h

    def windows(part):
        monkeypatch.setattr(dc, "PART", part)
        out, n = set(), 0
        for piece, before in dc.parts(raw):
            words = dc.Words([piece])
            n = before + len(words.hashes)
            out |= {(before + at, m, g, d) for _, at, m, g, d in dc.candidates(words, everything, [1, 9, 10], 10, 5)}
        return out, n

    whole, n = windows(1 << 20)
    assert n == 600 and len(whole) == 600 + 592 + 591
    assert all(windows(part) == (whole, n) for part in (1, 50, 333))


def test_no_match_across_documents(spark):
    texts = [" ".join(f"w{i}" for i in range(5)), " ".join(f"w{i}" for i in range(5, 10))]
    assert [x[1:] for x in found(spark, texts, [("a", " ".join(texts))])] == [([], []), ([], [])]


def test_repeated_words_take_linear_time(spark):
    """n equal words on both sides are n equal windows, not n times n hits."""
    import time

    n = 40_000
    words = dc.Words([b"x " * n])
    began = time.time()
    assert len(list(dc.candidates(words, lambda h: h == h, [10], 10, 5))) == n - 9
    assert time.time() - began < 3
    assert found(spark, ["x " * n, "y x"], [("a", "x " * n), ("b", "x")]) == [(n, list(range(n)), ["a", "b"]), (2, [1], ["b"])]


@pytest.mark.parametrize("broadcast", [0, 100])
def test_rows_and_columns_stay(spark, make_docs, broadcast):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(14))) for i in range(6)] + [(9, None), (None, "alone null item"), (3, "short repeat of id")]
    texts = [items[0][1] + " x " + items[5][1], "alone null item", "a short repeat of id b", None, "", items[2][1][:30]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(texts, extra=True).withColumn("text_key", F.lit(1))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id"))).unionByName(docs.where("doc_id = 0"))
    assert dc.contamination(docs, bench, "c").columns == [*docs.columns, "c"]
    rows = {r.doc_id: r.c for r in dc.contamination(docs, bench, "c").collect()}
    assert rows[0]["items"] == ["0", "5"] and [tuple(s) for s in rows[0].spans] == [(0, 14), (15, 29)]
    assert rows[1]["items"] == ["null"] and rows[2]["items"] == ["3"] and [tuple(s) for s in rows[2].spans] == [(1, 5)]
    assert rows[3].n_words == 0 and rows[4].spans == [] and rows[None].spans == []
    kept = dc.drop_contaminated(docs, bench, broadcast_keys=broadcast)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "None"]


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(make_docs(["a b"]), bench, "c").first().c.n_words == 2
    assert dc.drop_contaminated(make_docs(["a b", None, ""]), bench).count() == 3
    assert dc.contamination(make_docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert dc.drop_contaminated(make_docs([]), bench).count() == 0
