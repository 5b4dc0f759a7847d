"""Very long texts, slices of batches and parts of texts, in every operator."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strataloom.llm import _common, decontaminate, html_text, langid, packing, quality, sharding, simhash, token_files, toxicity
from strataloom.llm._tokens import public_path

WORDS = 900_000


@pytest.fixture(scope="module")
def long_docs(spark):
    """One text of about 6 MB, without an end of line, among short ones."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("thon", "era", "ing", "ou", "st") for b in ("ti", "on", "Er", "a,", "s.")]
    text = " ".join(rng.choices(words, k=WORDS))
    rows = [(1, text, "en"), (2, "short text of few words", "en"), (3, None, "de"), (4, "kurzer text", "de"), (5, text, "en"), (6, "x" * 3_000_000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), text


def test_slices_bound_bytes_and_keep_rows():
    texts = ["a" * n for n in (5, 500, 0, 30, 30, 30, 900)] + [None, "é" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["i", "t"])
    got = list(_common.slices([batch, batch.slice(0, 0)], 1, limit=90, rows=3))
    assert [x for b in got for x in b.column(1).to_pylist()] == texts
    sizes = [[len((x or "").encode()) for x in b.column(1).to_pylist()] for b in got]
    assert all(len(s) <= 3 and (sum(s) <= 90 or len(s) == 1) for s in sizes)


@pytest.mark.parametrize("text", [None, "", "a b", "word " * 50, "x" * 99, "\n\na\tb" * 30])
def test_parts_are_the_text(text):
    parts = list(_common.text_parts(text, 20))
    assert "".join(parts) == (text or "") and [w for p in parts for w in p.split()] == (text or "").split()


@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_fingerprints_in_parts(shingle):
    rng = random.Random(1)
    texts = [None, "", "a", "a b c"] + [" ".join(rng.choice("abcdefg") * rng.randrange(1, 9) for _ in range(n)) for n in (2, 7, 60, 300)]
    whole = simhash.fingerprints(texts, shingle)
    assert all((simhash.fingerprints(texts, shingle, part=n) == whole).all() for n in (1, 17, 100))
    assert simhash.fingerprints([]).tolist() == []


def test_long_tokens(spark, long_docs, tmp_path):
    docs, _ = long_docs
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, public_path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in token_files.read_documents(spark, path).collect()}
    assert rows[1].n_tokens > WORDS and rows[1].ids == rows[5].ids and rows[5].start > rows[1].start
    pieces = packing.pack(docs.where("doc_id < 5"), public_path("word_bpe_49k.json"), 1).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4} and max(r["sum(length)"] for r in pieces) > WORDS


def test_long_filters(spark, long_docs):
    docs, text = long_docs
    m = {r.doc_id: r.s for r in quality.with_signals(docs, "s").collect()}
    assert m[1].n_words == WORDS and m[1] == m[5] and m[6].n_words == 1
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[5].component_id == 1 and prints[1].fp == np.int64(simhash.fingerprints([text]).view(np.int64)[0])
    model = langid.train(docs)
    found = {r.doc_id: r.l for r in langid.predict(docs, model, "l", "score").collect()}
    assert found[1] == found[5] == "en" and found[3] == "und"
    scorer = toxicity.Model(np.array(sorted(toxicity.features("idiot"))), np.append(np.ones(len(toxicity.features("idiot"))), -1.0))
    assert toxicity.score(docs, scorer).count() == 6


def test_long_contamination(spark, long_docs):
    docs, text = long_docs
    words = text.split()
    items = [("end", " ".join(words[-12:])), ("middle", " ".join(words[400_000:400_030])), ("all", text)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = {r.doc_id: r.c for r in decontaminate.contamination(docs, bench, "c", keep=["doc_id"]).collect()}
    assert rows[1]["items"] == ["all", "end", "middle"] and rows[1].n_words == rows[1].spans[0].stop == WORDS and rows[1] == rows[5]
    assert rows[2].spans == [] and rows[6].n_words == 1
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3, 4, 6]


def test_long_pages_and_shards(spark, long_docs):
    docs, text = long_docs
    pages = docs.selectExpr("doc_id page_id", "concat('http://h.example/', doc_id) url", "concat('<nav>n</nav><article><p>', text, '</p></article>') html")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[1] == text and got[3] == ""
    rows = {r.doc_id: r.size for r in sharding.assign(docs, sharding.tree(4)).collect()}
    assert rows[1] == len(text) + 1 and rows[3] == 1
