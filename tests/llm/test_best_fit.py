import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataloom.llm import best_fit as bf
from strataloom.llm._tokens import public_path

TOK = public_path("byte_bpe_50k.json")


def sequential(sizes, capacity):
    """Best fit of decreasing sizes, one at a time."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def placed(spark, sizes, capacity):
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long").repartition(3)
    rows = bf.best_fit(items, capacity).collect()
    assert sorted(r["item"] for r in rows) == list(range(len(sizes)))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, sizes[r["item"]]))
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= capacity
    return len(bins)


def naive_matching(docs, gaps):
    """Documents from the largest take the smallest free place that holds them."""
    free, out = sorted(gaps, key=lambda g: (g[1], g[0])), {}
    for item, size in sorted(docs, key=lambda d: (-d[1], -d[0])):
        g = next((g for g in free if g[1] >= size), None)
        if g:
            free.remove(g)
            out[item] = g[0]
    return out


@pytest.mark.parametrize("rows", [1_000_000, 3])
def test_a_round_is_the_sequential_matching(spark, monkeypatch, rows):
    monkeypatch.setattr(bf, "RANGE_ROWS", rows)  # 3: nearly every pair meets across ranges
    rng = random.Random(rows)
    for n, m in ((12, 9), (5, 14)):
        docs = [(i, rng.randint(1, 12)) for i in range(n)]
        gaps = [(i, rng.randint(1, 12)) for i in range(m)]
        slots = bf._slots(spark.createDataFrame(gaps, "bin long, room long"), 13, 1)
        state = bf._round(spark.createDataFrame(docs, "item long, size long"), slots, n + m).collect()
        got = {r["item"]: r.bin for r in state if r.bin is not None}
        rooms, sizes = dict(gaps), dict(docs)
        want = naive_matching(docs, gaps)
        assert Counter((sizes[i], rooms[b]) for i, b in got.items()) == Counter((sizes[i], rooms[b]) for i, b in want.items())
        assert sorted(r["item"] for r in state) == list(range(n)) and len(set(got.values())) == len(got)
        left = bf.left_over(Counter(sizes.values()), Counter(rooms.values()))
        assert Counter(left) == Counter(sizes[i] for i in sizes if i not in want)


def test_places(spark):
    gaps = [(0, 10), (1, 3), (2, 7), (3, 10)]
    for most in (1, 2, 9):
        slots = bf._slots(spark.createDataFrame(gaps, "bin long, room long"), 4, most).collect()
        assert Counter(r.value for r in slots) == Counter(bf.offered(Counter(r for _, r in gaps), 4, most))
        for b, room in gaps:
            own = [r.value for r in slots if r.number == b]
            assert sum(own) == room and len(own) == max(1, min(room // 4, most)) and min(own) >= min(4, room)


def test_runs_meet_like_brackets():
    rng = random.Random(3)
    for _ in range(300):
        parts = [(rng.randint(0, 4), rng.randint(0, 4)) for _ in range(rng.randint(1, 6))]  # documents, gaps; gaps come first
        free, want = [], set()
        for p, (docs, gaps) in enumerate(parts):
            for g in range(gaps):
                if free:
                    want.add(((p, g), free.pop()))
            free += [(p, d) for d in range(docs)]
        got = set()
        for p, first, q, lowest, n in bf.across(dict(enumerate(parts))):
            got |= {((p, first + k), (q, lowest + n - 1 - k)) for k in range(n)}
        assert got == want


@pytest.mark.parametrize("kind", ["mixed", "tiny", "halves", "empty"])
def test_as_few_as_sequential_best_fit(spark, monkeypatch, kind):
    monkeypatch.setattr(bf, "RANGE_ROWS", 150)
    rng = random.Random(kind)
    sizes = {
        "mixed": [min(256, int(rng.lognormvariate(4, 1)) + 1) for _ in range(700)],
        "tiny": [rng.randint(1, 3) for _ in range(900)],
        "halves": [rng.randint(120, 140) for _ in range(300)],
        "empty": [],
    }[kind]
    n = placed(spark, sizes, 256)
    assert n <= 1.02 * sequential(sizes, 256) + 1
    assert n >= -(-sum(sizes) // 256)


def test_documents(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "Ünicode", "x", "\n"]) for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(60)]
    texts += [None, "", "word " * 2000, "word " * 2000, "a" * 64 * 5]
    rows = [(i if i % 7 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string").repartition(3)
    out = bf.pack_best_fit(docs, TOK, 0, capacity=64).collect()
    plain = Tokenizer.from_file(TOK)
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert all(zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32 for r in out)
    spans = defaultdict(list)
    for r in out:
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64


def test_no_documents(spark):
    out = bf.pack_best_fit(spark.createDataFrame([], "doc_id long, text string"), TOK, 0)
    assert out.collect() == [] and out.columns[0] == "doc_id"
