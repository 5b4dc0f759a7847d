import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strataloom.llm import spelling
from strataloom.llm._bits import BitMap
from strataloom.llm.spelling import Neighbourhood, occurrences, spelling_variants, vocabulary

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def counted(rows, divisor=199):
    out = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % divisor == 0:
                run = run[: (i := h % len(run))] + run[i + 1 :]
            out[run] += 1
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, shortest=6, least=5, factor=5, divisor=199):
    n = {w: k for w, k in counted(rows, divisor).items() if len(w) >= shortest and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def ran(docs, **k):
    return {tuple(r) for r in spelling_variants(docs, **k).collect()}


def rows_of(seed, n_docs=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcéÿ") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    words += ["banana", "bananna", "bannana", "banan", "bananas", "Banana", "aaaaaa", "aaaaaaa"]
    seps = [" ", ", ", "\n", "-", "1", "　", "ž"]
    out = []
    for i in range(n_docs):
        text = "".join(rng.choices(words, weights=range(len(words), 0, -1))[0] + rng.choice(seps) for _ in range(rng.randint(0, 120)))
        out.append((i, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = rows_of(seed) + [(None, "banana banana"), (3, None), (4, ""), (4, "bananas")]
    docs = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id long, text string, word string, n int, form string").repartition(3)
    for divisor in (199, 3):
        assert ran(docs, shortest=5, least=2, factor=2, divisor=divisor) == brute(rows, 5, 2, 2, divisor)


def test_chains_and_ties(spark):
    counts = {"abcdef": 1, "abcdeg": 2, "abcdhg": 4, "abcihg": 8, "abjihg": 16, "zzzzzy": 5, "zzzzzx": 5, "zzzzzw": 1}
    rows = [(0, " ".join(w for w, k in counts.items() for _ in range(k)))]
    got = ran(spark.createDataFrame(rows, "doc_id long, text string"), least=1, factor=2, divisor=1 << 31)
    assert got == brute(rows, 6, 1, 2, 1 << 31)
    by = {r[0]: r for r in got}
    assert by["abcdef"][2] == "abjihg"  # four steps
    assert by["zzzzzw"][1] == "zzzzzx"  # the smaller of equals


def test_occurrences_like_a_plain_loop():
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("abÉéZ .-1") for _ in range(rng.randint(0, 400)))) for i in range(30)]
    docs.append((99, "x" * 500 + " " + "é" * 70))
    group = [(i, spelling.latin(t)) for i, (_, t) in enumerate(docs)]
    for divisor in (199, 2):
        got = occurrences(group, [f"{d}:".encode() for d, _ in docs], divisor)
        assert {w.decode("latin-1"): k for w, k in got.items() if w} == {w: k for w, k in counted(docs, divisor).items() if w}


def test_all_edits_are_made_once():
    words = [b"aab", b"b", b"abba"]
    alphabet = np.frombuffer(b"abc", dtype=np.uint8)
    around = Neighbourhood(words)
    made = [[] for _ in words]
    hashes = []
    for place, letter, kind in around.candidates(alphabet, lambda h: hashes.append(h) or np.ones(len(h), dtype=bool)):
        for p, c in zip(place.tolist(), letter.tolist()):
            made[around.owner[p]].append(around.spell(p, c, kind))
    for w, got in zip(words, made):
        want = {w[:i] + w[i + 1 :] for i in range(len(w))}
        want |= {w[:i] + bytes((c,)) + w[i + 1 :] for i in range(len(w)) for c in b"abc"} - {w}
        want |= {w[:i] + bytes((c,)) + w[i:] for i in range(len(w) + 1) for c in b"abc"}
        assert len(got) == len(set(got)) and set(got) == want
    # The hash of an edit is that of the string as a word.
    flat = []
    for place, letter, kind in around.candidates(alphabet, lambda h: np.ones(len(h), dtype=bool)):
        flat += [around.spell(p, c, kind) for p, c in zip(place.tolist(), letter.tolist())]
    real = [s for s in flat if s]
    want = dict(zip(real, Neighbourhood(real).hash.tolist()))
    got = [int(x) for h in hashes for x in h]
    assert [want[s] for s in flat if s] == [g for s, g in zip(flat, got) if s]


def test_a_full_bit_map_loses_nothing(spark, monkeypatch):
    rows = rows_of(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = ran(docs, shortest=5, least=2, factor=2)
    monkeypatch.setattr(spelling, "BitMap", lambda h: BitMap(h, most_bits=7))
    assert ran(docs, shortest=5, least=2, factor=2) == whole


def test_empty_and_long(spark):
    schema = "doc_id long, text string"
    assert ran(spark.createDataFrame([], schema)) == set()
    assert ran(spark.createDataFrame([(1, None), (2, "")], schema)) == set()
    long = "wonder " * 300_000 + "y" * 1_500_000 + " wonders" * 10
    got = {r.word: r.n for r in vocabulary(spark.createDataFrame([(1, long)], schema), least=1, divisor=1 << 31).collect()}
    assert got == {"wonder": 300_000, "y" * 1_500_000: 1, "wonders": 10}


def test_bad_factor(spark):
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame([], "doc_id long, text string"), factor=1)
