import random

import pytest

from strataloom.operators import tagging
from strataloom.operators.tagging import Automaton, longest, tag

TERMS = "form string, label string, expansion string"


def brute(texts, terms, overlap=True):
    out = set()
    for key, text in texts:
        w = (text or "").split()
        found = [(i, f) for i in range(len(w)) for n in range(1, 7) for f in [" ".join(w[i : i + n])] if i + n <= len(w) and f in {t[0] for t in terms}]
        if not overlap:
            found = longest(found)
        hits = {(key, i, f, label, exp) for i, f in found for form, label, exp in terms if form == f}
        out |= {h[:4] for h in hits}
        for exp, label in {(h[4], h[3]) for h in hits if h[4] is not None}:
            out.add((key, min(h[1] for h in hits if h[4] == exp and h[3] == label), exp, label))
    return out


def data(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(30)] + [(90, None), (91, ""), (92, "  a \n b\tc ")]
    forms = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(14)}
    terms = [(f, rng.choice("XY"), rng.choice([None, None, "long form"])) for f in sorted(forms)]
    return texts, terms + [(terms[0][0], "Z", None)]


def test_tags(spark):
    texts, terms = data(1)
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts], "k int, t string, form string").repartition(3)
    known = spark.createDataFrame(terms, TERMS)
    for options in ({}, {"term_bytes": 0}, {"overlap": False}):
        got = {tuple(r) for r in tag(df, "k", "t", known, **options).collect()}
        assert got == brute(texts, terms, options.get("overlap", True)) and got


def test_automaton_finds_what_lies_inside(spark):
    a = Automaton(["x y z", "y", "y z", "z x", "x y z x y"]).open()
    assert sorted(a.find("x y z x y q y")) == sorted([(0, "x y z"), (1, "y"), (1, "y z"), (2, "z x"), (0, "x y z x y"), (4, "y"), (6, "y")])
    assert longest(list(a.find("x y z x y q y"))) == [(0, "x y z x y"), (6, "y")]


def test_no_terms_and_too_many(spark):
    df = spark.createDataFrame([(1, "a b")], "k int, t string")
    none = spark.createDataFrame([], TERMS)
    assert tag(df, "k", "t", none).collect() == [] and tag(df.limit(0), "k", "t", spark.createDataFrame([("a", "X", None)], TERMS)).collect() == []
    with pytest.raises(ValueError):
        tag(df, "k", "t", spark.createDataFrame([("a", "X", None)], TERMS), overlap=False, term_bytes=0)
    assert tagging.TERM_BYTES > 0
