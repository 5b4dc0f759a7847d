import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from strataloom.llm import quality as q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, hit = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


TEXTS = [None, "", " \t\n", "a b c a b c", "a a a a a", "x\ny\nx\n \n \ny", "é\u00a0b\x1cc #*$", "a b c d a b c", "1 2 3 1 2 3 1 2 3 4", "w " * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert q.measure(text)[:5] == brute(text)


def tail(k, n, p):
    """P(at most k of n) by exact fractions."""
    p = Fraction(p)
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def proven(k, n, risk, error):
    """Whether k rejections of n prove a rate of at most ``risk`` at ``error``."""
    return n > 0 and k <= risk * n and tail(k, n, Fraction(risk).limit_denominator(1000)) <= error


def test_exact_bound():
    # P(no rejection among n) = (1 - risk)^n must reach the error.
    assert not q.within(0, 148, 0.02, 0.05) and q.within(0, 149, 0.02, 0.05)
    assert abs(q.binomial_cdf(3, 10, 0.3) - 0.6496107184) < 1e-9
    for n in (0, 1, 149, 400, 1000):
        for k in range(0, 30):
            assert q.within(k, n, 0.02, 0.05) == (k < n and proven(k, n, 0.02, 0.05)), (k, n)


def test_cutoff_stops_at_first_unproven():
    rejected = [0] * (q.GRID + 1)
    rejected[0], rejected[40], rejected[5] = 967, 3, 30
    # 3 of 1,000 are proven to stay within the risk, 33 of 1,000 are not.
    assert proven(3, 1000, 0.02, 0.05) and not proven(33, 1000, 0.02, 0.05)
    assert q.cutoff(rejected, 1000, 0.02, 0.05) == 6
    # 10 of 1,000 have probability 0.0102 at the risk: proven, so every cutoff is.
    rejected[0], rejected[5] = 990, 7
    assert proven(10, 1000, 0.02, 0.05) and q.cutoff(rejected, 1000, 0.02, 0.05) == 1
    assert q.cutoff([0] * (q.GRID + 1), 0, 0.02, 0.05) is None


@pytest.mark.parametrize("n", [4, 50, 400])
def test_long_texts_are_counted_alike(n, monkeypatch):
    rng = random.Random(n)
    words = [rng.choice("abcdefgh").encode() for _ in range(n)]
    want = brute(b" ".join(words).decode())[4]
    assert q.repeated_words(words) == want
    monkeypatch.setattr(q, "LONG", 3)
    assert q.repeated_words(words) == want


def verdicts(docs, labels, risk, error):
    """kept by plain Python: (doc_id, text, stratum) rows and (doc_id, quality) rows."""
    def bad(text):
        n, _, symbols, dup, repeats = brute(text)
        text = text or ""
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        upper = sum(w.isupper() for w in (x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text)))
        failed = n < 50 or 100 * repeats > 50 * n
        shares = {"symbols": symbols / max(n, 1), "repeats": repeats / max(n, 1), "lines": dup / max(len(lines), 1), "upper": upper / max(n, 1)}
        worst = max((shares[k] - lo) / (hi - lo) for k, (lo, hi) in q.SCALES.items())
        return failed, math.floor(min(1.0, max(0.0, worst)) * q.GRID)

    judged = [(i, s, *bad(t)) for i, t, s in docs]
    good = {i for i, y in labels if y == 1 and i is not None}
    trials = {}
    for i, s, failed, b in judged:
        if i in good and not failed:
            trials[i] = max(trials.get(i, (-1, "")), (b, str(s)))
    strata = {s for _, s in trials.values()}
    cut = {}
    for s in strata:
        bads = [b for b, x in trials.values() if x == s]
        for c in range(q.GRID, 0, -1):
            k = sum(b >= c for b in bads)
            if not (k < len(bads) and proven(k, len(bads), risk, Fraction(error).limit_denominator(1000) / len(strata))):
                break
            cut[s] = c
    return sorted((str(i), not failed and b < cut.get(str(s), 1000)) for i, s, failed, b in judged), cut


def test_verdicts_by_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]

    def text(junk):
        out = [rng.choice(words) + ("#$" if rng.random() < junk else "") for _ in range(rng.choice([30, 60, 80, 120]))]
        return " ".join(out)

    docs = [(i, text(rng.choice([0, 0, 0, 0, 0.02, 0.3, 0.9])), [None, "", "en", "de"][i % 4]) for i in range(1600)]
    docs += [(5, text(0.9), "en"), (5, text(0), "en"), (None, text(0.3), "de"), (2000, None, "en"), (2001, "", None)]
    labels = [(i, 1) for i, t, _ in docs[:1600] if t.count("#") < 3 or i % 90 == 0] + [(7, 0), (7, 1), (None, 1), (3000, 1), (9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    rows = q.judge(df, spark.createDataFrame(labels, "doc_id long, quality int"), "s", "kept", risk=0.05).collect()
    want, cut = verdicts(docs, labels, 0.05, q.ERROR)
    assert cut and sorted((str(r.doc_id), r.kept) for r in rows) == want


def test_query_counts_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in q.op2_quality_rules(spark, "/root/testdata/sf0.001").collect():
        n, chars, symbols, dup, repeats = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.kept and r.base_failed)


def test_judge_keeps_rows_and_columns(spark, make_docs):
    good = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}***" for i in range(60))
    texts = [good + f" {i}" for i in range(400)] + [junk + f" {i}" for i in range(40)] + [None, "", "short"]
    docs = make_docs(texts, extra=True)
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(0, 0), (401, 0), (None, 1), (5, None)], "doc_id long, quality int")
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
    assert sorted(r.doc_id for r in q.keep_good(docs, labels.limit(0)).collect()) == list(range(440))
    assert q.keep_good(docs.limit(0), labels).count() == 0


def test_false_rejections_stay_limited(spark):
    rows = q.op2_quality_rules(spark, "/root/testdata/sf0.1")
    good = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1").select("doc_id")
    by = rows.where("not base_failed").join(good, "doc_id").groupBy("cutoff").agg({"kept": "count"}).count()
    lost = rows.where("not base_failed and not kept").join(good, "doc_id").count()
    assert by >= 1 and lost <= 0.02 * rows.where("not base_failed").join(good, "doc_id").count()
