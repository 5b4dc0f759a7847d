import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from strataloom.llm import phrases
from strataloom.llm._bits import BitMap
from strataloom.llm.phrases import _counted, collocations, distinct_pieces, frequent_phrases, text_pieces

SCHEMA = "doc_id long, text string, lang string, phrase string, times int"


def words_of(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    for piece in re.split("[.,;:!?\x0a-\x0d]", low):
        w = re.findall("[^\x20\x09]+", piece)
        if w:
            yield w


def brute(rows, longest=5, least=100, share=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in words_of(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = set()
    for lang, count in f.items():
        cands = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= share * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), " ".join(p), a, count[p[:k]], count[p[k:]], score))
        for rank, (_, _, _, p, a, l, r, score) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p, a, l, r, n[lang], score))
    return out


def rows_of(seed, n=60):
    rng = random.Random(seed)
    words = ["new", "York", "city", "the", "of", "Ångström", "a\xa0b", "ż", "x", "The"]
    out = []
    for _ in range(n):
        text = "".join(rng.choices(words, weights=range(len(words), 0, -1))[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(rng.randint(0, 60)))
        out.append((text, rng.choice(["en", "de", None])))
    return out + out[:10] * 3 + [(None, "en"), ("", None), ("only", "fr"), ("new york city " * 30, "en")]


def ran(spark, rows, **k):
    docs = spark.createDataFrame([(i % 5, t, l, "clash", 1) for i, (t, l) in enumerate(rows)], SCHEMA).repartition(3)
    return {tuple(r) for r in collocations(docs, **k).collect()}


@pytest.mark.parametrize("options", [{"least": 5, "share": 60, "top": 7}, {"least": 2, "longest": 2}, {"least": 4, "longest": 7}])
def test_against_brute_force(spark, options):
    rows = rows_of(len(options))
    got = ran(spark, rows, **options)
    assert got == brute(rows, **options) and got


def test_small_parts_and_flushes(spark, monkeypatch):
    """Overlapping parts of pieces, early flushes and a full bit map change nothing."""
    rows = rows_of(9)
    want = brute(rows, least=3)
    monkeypatch.setattr(phrases, "PART", 40)
    monkeypatch.setattr("strataloom.llm.decontaminate.PART", 30)
    monkeypatch.setattr(phrases, "GATHERED", 50)
    monkeypatch.setattr(phrases, "STRINGS", 20)
    monkeypatch.setattr(phrases, "HELD_BYTES", 100)
    monkeypatch.setattr(phrases, "BitMap", lambda h: BitMap(h, most_bits=7))
    assert ran(spark, rows, least=3) == want


def test_parts_of_a_long_piece_count_each_phrase_once(monkeypatch):
    monkeypatch.setattr("strataloom.llm.decontaminate.PART", 20)
    piece = " ".join(f"w{i}" for i in range(100))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "piece": [piece], "times": [3]})
    for k in range(1, 6):
        found = Counter()
        for g in phrases._grouped([batch], 5):
            h, new = g.of(k)
            at = new.nonzero()[0]
            found.update(g.strings(at, k).to_pylist())
        w = piece.encode().split()
        assert found == Counter(b" ".join(w[i : i + k]) for i in range(len(w) - k + 1))


def test_pieces(spark):
    assert text_pieces(" A  b\t C. d ;; e\x0b") == [b"a b c", b"d", b"e"]
    docs = spark.createDataFrame([("a b. a  b", None), ("A b", "und"), (None, "en")], "text string, lang string")
    assert [tuple(r) for r in distinct_pieces(docs).collect()] == [("und", "a b", 2, 3)]


def test_exact_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", "a b", 2, 3_000_000_007), ("en", "a", 1, 4_000_000_001), ("en", "b", 1, 5_000_000_003)], "lang string, phrase string, words int, times long")
    totals = spark.createDataFrame([("en", 9_000_000_000_000_000)], "lang string, n long")
    r = phrases._scored(grams, totals).collect()[0]
    assert r.score == 1000 * 3_000_000_007 * 9_000_000_000_000_000 // (4_000_000_001 * 5_000_000_003)


def test_duckdb_spills(monkeypatch):
    import numpy as np

    monkeypatch.setattr(phrases, "MEMORY", "40MB")
    n = 1_500_000

    def batches():
        for i in range(2):
            for a in range(0, n, 50_000):
                x = np.arange(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([f"phrase of some length {v}" for v in x.tolist()]), pa.array(x % 7 + 1)], names=["phrase", "times"])

    total = sum(b.num_rows for b in _counted(batches(), ["phrase"], 14))
    assert total == sum(2 * (v % 7 + 1) >= 14 for v in range(n))


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations(empty).collect() == []
    assert frequent_phrases(distinct_pieces(empty)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None, "", 1)], SCHEMA)).collect() == []
