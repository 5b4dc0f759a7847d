import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strataloom.llm import _tokens, packing, token_files
from strataloom.llm._tokens import Encoder, public_path
from strataloom.llm.token_files import Code

random.seed(5)
ALPHABET = list("ab A.,'s\n\n  \t é́Σσ1²½９ \x1c\x85 'll'REΩ漢字😀<|endoftext|>#$_-\x00İß")
FUZZ = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 50))) for _ in range(1500)]
FUZZ += ["<|endoftext|> a <|startoftext|>", " x", "x ", "\n", "a\n\nb", "a \nb", "Hello, world!!\nIt's fine."]


FUZZ += ["".join(random.choice([*ALPHABET, "<|endoftext|>", "<|startoftext|>", " word", " Wörter."]) for _ in range(random.randint(0, 60))) for _ in range(600)]
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name):
    """The tokenizer as the library loads it."""
    tokenizer = Tokenizer.from_file(public_path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("cache", [50, 10_000])
def test_pieces_give_the_ids_of_whole_texts(name, cache):
    e, want = Encoder(public_path(name), cache), library(name)
    for i in range(0, len(FUZZ), 300):
        for text, got in zip(FUZZ[i : i + 300], e.encode(FUZZ[i : i + 300])):
            assert got.tolist() == want(text), text
    assert [x.tolist() for x in e.encode([None, ""])] == [[], []] and e.encode([]) == []


@pytest.mark.parametrize("name", NAMES)
def test_long_texts_are_encoded_in_parts(name, monkeypatch):
    monkeypatch.setattr(_tokens, "PART", 40)
    monkeypatch.setattr(_tokens, "GROUP", 500)
    e, want = Encoder(public_path(name), 1000), library(name)
    long = ["".join(random.choice([*ALPHABET, *[" word"] * 9]) for _ in range(3000)) for _ in range(20)] + ["x" * 3000, "é" * 500]
    assert [x.tolist() for x in e.encode(long)] == [want(t) for t in long]


def test_added_tokens_as_text():
    e = Encoder(public_path(NAMES[0]), special_as_text=True)
    assert e.encode(["a <|endoftext|> b"])[0].tolist() == [64, 1279, 91, 437, 1659, 5239, 91, 29, 275]
    assert Encoder(public_path(NAMES[0])).encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_code_round_trip_and_access(n):
    v = np.random.default_rng(n).integers(0, 1 << 20, n)
    v[::3] = 0
    v[1::5] %= 256
    c = Code.from_bytes(Code.of(v).to_bytes())
    assert (c.slice(0, n) == v).all() and (c.all() == v).all()
    assert all(int(c.take(np.array([i]))[0]) == v[i] for i in range(0, n, 7))
    with pytest.raises(IndexError):
        c.take(np.array([n]))


def test_files_hold_all_ids_in_order(spark, tmp_path, make_docs):
    texts = ["b b", None, "", "long " * 3000, "a", "b b"]
    docs = make_docs(texts, extra=True).orderBy("text")
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, public_path("byte_bpe_50k.json"))
    want = library("byte_bpe_50k.json")
    all_ids, at = [], 0
    for r in sorted(token_files.read_documents(spark, path).collect()):
        ids = [*want(texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
        all_ids += ids
    places = [0, 3, len(all_ids) // 2, len(all_ids) - 1]
    assert token_files.tokens_at(spark, path, places) == {p: all_ids[p] for p in places}
    assert token_files.tokens_at(spark, path, []) == {}
    for place in (-1, len(all_ids)):
        with pytest.raises(IndexError):
            token_files.tokens_at(spark, path, [place])


def test_files_of_an_empty_table(spark, tmp_path, make_docs):
    path = f"file://{tmp_path}/none"
    token_files.write_tokens(make_docs([]), path, public_path("byte_bpe_50k.json"))
    assert token_files.read_documents(spark, path).count() == 0


def check_sequences(sequences, limits):
    for seq in sequences:
        t, x = zip(*(p.demand() for p in seq))
        assert sum(t) <= limits.tokens and len(seq) <= limits.segments and sum(x) <= limits.loss


@pytest.mark.parametrize("limits", [packing.Limits(64, 8, 64, 16), packing.Limits(64, 4, 40, 16, 1), packing.Limits(64, 64, 10, 4)])
def test_packer_keeps_limits_and_ids(limits):
    rng = random.Random(1)
    packer, out, want = packing.Packer(limits), [], {}
    for d in range(300):
        n = rng.choice([1, 2, 5, 30, 63, 64, 65, 200])
        loss = np.array([rng.random() < 0.7 for _ in range(n)]) if d % 2 else None
        want[d] = list(range(d * 1000, d * 1000 + n))
        out += list(packer.add(packing.Piece(d, 0, np.array(want[d]), n, loss)))
    out += list(packer.pack())
    check_sequences(out, limits)
    got = {}
    for p in sorted((p for s in out for p in s), key=lambda p: (p.doc, p.start)):
        assert p.start == len(got.setdefault(p.doc, []))
        got[p.doc] += p.ids.tolist()
    assert got == want


def test_packed_documents_cover_all(spark, make_docs):
    texts = [None, "", "one two", "one two", "word " * 5000, *(f"text number {i} " * (i % 90 + 1) for i in range(400))]
    rows = packing.packed_documents(make_docs(texts, extra=True).coalesce(1)).collect()
    by_doc, by_seq, want = {}, {}, library("word_bpe_49k.json")
    whole = {i: [*want(t), 1] for i, t in enumerate(texts)}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == by_doc.get(r.doc_id, 0)
        by_doc[r.doc_id] = r.start + r.length
        assert r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(range(len(texts))) and by_doc[0] == by_doc[1] == 1
    pad = total = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        total, pad = total + at, pad + (2048 - at if at & (at - 1) else 0)
    assert pad <= 0.05 * total
    assert packing.packed_documents(make_docs([])).count() == 0


def test_dot_product_looks_at_all_limits():
    """With few loss tokens left, a shorter piece that bears much loss is not the one to take."""
    limits = packing.Limits(tokens=100, segments=8, loss=20, pool=4)

    def piece(doc, n, loss):
        mask = np.zeros(n, dtype=bool)
        mask[1 : loss + 1] = True
        return packing.Piece(doc, 0, np.arange(n), n, mask)

    # Demands (tokens, loss): the longest piece alone would be 50 tokens; as shares of
    # the limits (0.5, 0.05) has the dot product 0.55 and (0.4, 0.9) has 1.3.
    packer = packing.Packer(limits)
    for p in (piece("long", 50, 1), piece("dense", 40, 18), piece("rest", 10, 1)):
        assert not list(packer.add(p))
    first = next(packer.pack())
    assert [p.doc for p in first] == ["dense", "long", "rest"]
    check_sequences([first], limits)


def test_queries_agree_with_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want, at = library("byte_bpe_50k.json"), 0
    for r in sorted(token_files.op5_token_files(spark, "/root/testdata/sf0.001").collect()):
        ids = [*want(docs[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    want, seen = library("word_bpe_49k.json"), dict.fromkeys(docs, 0)
    for r in sorted(packing.op3_packing(spark, "/root/testdata/sf0.001").collect(), key=lambda r: (r.doc_id, r.start)):
        ids = [*want(docs[r.doc_id]), 1]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
        seen[r.doc_id] += r.length
    assert all(n == len(want(docs[i])) + 1 for i, n in seen.items())
