import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import langid, toxicity
from strataloom.llm._common import remainder

SF = "/root/testdata/sf0.1"


def test_grams_do_not_cross_texts():
    alone = [langid.grams([t]) for t in ("abc", "xyz")]
    both, first, has = langid.grams(["abc", "xyz"])
    for k in range(len(langid.ORDERS)):
        assert both[k].tolist() == alone[0][0][k].tolist() + alone[1][0][k].tolist()
    assert has.tolist() == [True, True] and first.tolist() == [0, len(alone[0][0][0])]


def test_marks_count_as_one_space():
    a, b = langid.grams(["ab cd"])[0], langid.grams(["ab?? 12 cd"])[0]
    assert [x.tolist() for x in a] == [x.tolist() for x in b]


def plain_grams(text):
    """Bucket numbers of a text's n-grams, one at a time."""
    chars = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()]
    chars = [32, *[c for i, c in enumerate(chars) if c != 32 or (i > 0 and chars[i - 1] != 32)], *([32] * 4)]
    if len(chars) > 5 and chars[-5] == 32:  # the space after the last letter is one of the four at the end
        chars = chars[:-1]
    out = []
    for n in langid.ORDERS:
        for i in range(len(chars)):
            h = 0
            if i + n > len(chars):
                out.append(0)
                continue
            for c in chars[i : i + n]:
                h = ((h ^ c) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h % langid.BUCKETS)
    return out


def test_language_by_brute_force(spark):
    """Counts, probabilities and posteriors of every text by plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    extra = [(None, "sin id alguno", None), (9001, None, "en"), (9002, "", "fr"), (9003, "12 !?", "de"), (9004, "ab", None), (9004, "ab", None)]
    rows = [(r.doc_id, r.text[:400], r.lang) for r in docs[:60]] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df)
    counts = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            for g in plain_grams(text):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    assert model.classes == sorted(counts)
    log = {}
    for lang, c in counts.items():
        total = sum(c.values()) + langid.SMOOTHING * langid.BUCKETS
        log[lang] = lambda g, c=c, total=total: math.log((c.get(g, 0) + langid.SMOOTHING) / total)
    got = langid.predict(df, model, "lang_pred", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        grams = plain_grams(r.text)
        z = {lang: sum(map(f, grams)) * min(len(grams), langid.EVIDENCE) / len(grams) for lang, f in log.items()}
        top = max(z.values())
        best = min(lang for lang in z if z[lang] == top)
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(v - top) for v in z.values())) < 1e-3


def test_long_texts_in_parts():
    """Parts change n-grams at their borders only."""
    model = langid.Model(["aa", "bb"], np.random.default_rng(0).random((langid.BUCKETS, 2)) * 9)
    text = "the cat and the dog " * 400
    want, old = model.predict([text, "short"]), langid.pieces_of
    try:
        langid.pieces_of = lambda texts: old(texts, part=2000, group=3000)
        got = model.predict([text, "short"])
    finally:
        langid.pieces_of = old
    assert got[0] == want[0] and abs(got[1] - want[1]).max() < 0.02


def test_scores_are_posteriors():
    counts = np.ones((langid.BUCKETS, 2))
    m = langid.Model(["aa", "bb"], counts)
    names, scores = m.predict(["text", None, "12 !", "", "\U00020000"])
    assert names == ["aa", "und", "und", "und", "aa"] and abs(scores[0] - 0.5) < 1e-9 and scores[1:4].tolist() == [0, 0, 0]


def test_language_on_held_out_rows(spark):
    rows = langid.op7_language_id(spark, SF).where("held_out")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = rows.join(docs, "doc_id").selectExpr("avg(cast(lang = lang_pred as double)) a", "min(score) lo", "max(score) hi").first()
    assert right.a > 0.98 and 0 <= right.lo <= right.hi <= 1


def test_labels_of_held_out_rows_do_not_matter(spark, make_docs):
    import zlib

    texts = ["the cat and the dog"] * 30 + ["der hund und die katze"] * 30
    langs = ["en"] * 30 + ["de"] * 30
    wrong = ["de" if zlib.crc32(str(i).encode()) % 3 == 1 and x == "en" else x for i, x in enumerate(langs)]
    for given in (langs, wrong):
        docs = make_docs(texts, given, extra=True)
        model = langid.train(docs.where(remainder("doc_id", 3) != 1))
        assert model.predict(["the cat", "die katze"])[0] == ["en", "de"]


def test_identified_rows_stay(spark, make_docs):
    docs = make_docs(["the cat and the dog", None, "", "123 !", "der hund und die katze"], ["en", "en", None, "en", "de"], extra=True)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 4]
    assert sorted(r.doc_id for r in langid.keep_identified(make_docs(["x", "1"], [None, None])).collect()) == [0]
    assert langid.keep_identified(make_docs([])).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rows = toxicity.op10_toxicity(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    hit = rows.predicted[rows.toxic == 1].mean()
    false = rows.predicted[rows.toxic == 0].mean()
    assert hit > 0.75 and false < 0.03 and rows.score.between(0, 1).all()


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    pos, unl = 200, 1000  # feature 0 marks the positives, a fifth of the unlabelled
    rows = [np.arange(pos), np.concatenate((np.arange(200), np.arange(unl)))]
    cols = [np.zeros(pos, int), np.concatenate((np.zeros(200, int), rng.integers(1, 4, unl)))]
    vals = [np.ones(len(r)) for r in rows]
    w = toxicity.fit(rows, cols, vals, [pos, unl], 4, prior=0.2)
    assert 1 / (1 + math.exp(-w[-1] - w[0])) > 0.8 > 0.3 > 1 / (1 + math.exp(-w[-1] - w[1]))


def test_fit_by_brute_force():
    """The same steps with dense matrices, loops and the risk written out."""
    rng = np.random.default_rng(1)
    width, sizes, prior = 6, [30, 80], 0.3
    dense = [rng.integers(0, 3, (n, width)).astype(float) for n in sizes]
    dense[0][:, 0] += 2
    sparse = [np.nonzero(x) for x in dense]
    rows, cols, vals = [r for r, _ in sparse], [c for _, c in sparse], [x[i] for x, i in zip(dense, sparse)]

    def risk_rest(w):
        g = [x @ w[:-1] + w[-1] for x in dense]
        return np.log1p(np.exp(g[1])).mean() - prior * np.log1p(np.exp(g[0])).mean()

    def risk_positive(w):
        return prior * np.log1p(np.exp(-(dense[0] @ w[:-1] + w[-1]))).mean()

    def slope(f, w):
        return np.array([(f(w + h) - f(w - h)) / 2e-6 for h in np.eye(width + 1) * 1e-6])

    w = m = v = np.zeros(width + 1)
    for step in range(1, 26):
        grad = slope(lambda x: risk_positive(x) + risk_rest(x), w) if risk_rest(w) >= 0 else -slope(risk_rest, w)
        grad = grad + np.append(1e-3 * w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert abs(toxicity.fit(rows, cols, vals, sizes, width, prior, steps=25) - w).max() < 1e-3


def test_toxicity_scores_by_brute_force(spark, make_docs):
    """Weights of every distinct token's features, added up; repeated rows and long texts too."""
    chosen = np.unique([f for w in ("idiot", "stupid", "fool") for f in toxicity.features(w)])
    weights = np.append(np.linspace(0.5, 2.5, len(chosen)), -1.0)
    model, of = toxicity.Model(chosen, weights), dict(zip(chosen.tolist(), weights))
    texts = [None, "", "you idiot", "Idiots! idiot idiot", "a stupid fool", "fine " * 50, "you idiot", "x" * 10 + " stupid"]
    for r in toxicity.score(make_docs(texts), model, "toxicity").collect():
        g = -1.0 + sum(of.get(f, 0.0) for token in set((texts[r.doc_id] or "").split()) for f in toxicity.features(token))
        assert abs(r.toxicity - 1 / (1 + math.exp(-g))) < 1e-9


def test_long_clean_texts_stay_clean(spark):
    """Many clean documents in one text have no score of a toxic one, and toxic ones in a row still do."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null")
    held_out = remainder("doc_id", 4) == 2
    model = toxicity.train(docs.where(~held_out).select("doc_id", "text"), labels.where(~held_out & (labels.toxic == 1)), 0.11)
    texts = {y: [r.text for r in docs.join(labels.where(held_out & (labels.toxic == y)), "doc_id").select("text").collect() if r.text] for y in (0, 1)}
    clean = [t for t, s in zip(texts[0], model.score(texts[0], {})) if s < toxicity.THRESHOLD]
    for n in (10, 40):
        whole = [" ".join(clean[i : i + n]) for i in range(0, len(clean) - n, n)]
        assert (model.score(whole, {}) >= toxicity.THRESHOLD).mean() <= 0.1
    toxic = [" ".join(texts[1][i : i + 10]) for i in range(0, len(texts[1]) - 10, 10)]
    assert (model.score(toxic, {}) >= toxicity.THRESHOLD).mean() >= 0.9


def test_background_is_that_of_clean_texts():
    sums, n = np.array([9.0] * 30 + [4.0] * 60), np.array([100.0] * 30 + [200.0] * 60)
    assert abs(toxicity.background(sums, n, 5.0) - 0.02) < 1e-12 and toxicity.background(sums, n, 0.0) == 0


def test_operating_point_splits():
    g = toxicity.operating_point(np.array([2.0, 3.0, 2.5]), np.array([-1.0] * 90 + [2.2] * 10), 0.1)
    assert -1 < g <= 2.2


def test_toxicity_edges(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long")
    docs = make_docs(["you idiot"] * 20 + ["a fine day"] * 60 + [None, ""])
    assert toxicity.train(docs, none, 0.1) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    model = toxicity.train(docs, spark.createDataFrame([(i,) for i in range(12)] + [(None,), (999,)], "doc_id long"), 0.25)
    got = {r.doc_id: r.score for r in toxicity.score(make_docs(["you idiot", "a fine day", None, "", "IDIOT!"], extra=True), model, "toxicity").selectExpr("doc_id", "toxicity score").collect()}
    assert min(got[0], got[4]) > 0.3 > max(got[1], got[2], got[3]) and got[2] == got[3]
    assert toxicity.score(make_docs([]), model).count() == 0


def test_clashing_names_are_replaced(spark, make_docs):
    docs = make_docs(["you idiot", None], extra=True).withColumn("Lang_Pred", F.lit("old"))
    got = toxicity.score(docs, None, "score")
    assert got.columns.count("score") == 1 and {r.score for r in got.collect()} == {0.0}
    out = langid.predict(docs, None, "lang_pred", "score")
    assert {(r.lang_pred, r.score) for r in out.select("lang_pred", "score").collect()} == {("und", 0.0)}
    with pytest.raises(ValueError):
        toxicity.score(docs, None, "TEXT")


def test_too_many_labels_are_an_error(spark, make_docs, monkeypatch):
    monkeypatch.setattr(langid, "TABLE_BYTES", 4 * langid.BUCKETS * 2)
    assert langid.train(make_docs(["a", "b"], ["x", "y"])).classes == ["x", "y"]
    with pytest.raises(ValueError):
        langid.train(make_docs(["a", "b", "c"], ["x", "y", "z"]))
