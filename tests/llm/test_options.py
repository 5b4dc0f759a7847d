"""Options of operators: loss spans, spans of text, blocks of labels, deleted lines."""


def test_deleted_lines_are_those_the_pairing_removes():
    from strataloom.llm.html_text import main_text

    article = [("menu", True, False), ("outside", False, False), ("own", False, True), ("common", False, True)]
    assert main_text(article, [1, 2, 3, 4], [1, 2, 4]) == ("own common", 0)
    plain = [("menu", True, False), ("own", False, False), ("common", False, False)]
    assert main_text(plain, [1, 3, 4], [1, 4]) == ("own", 1)


def test_packing_by_loss_spans(spark):
    import numpy as np

    from strataloom.llm import packing
    from strataloom.llm._tokens import Encoder, public_path

    path = public_path("byte_bpe_50k.json")
    texts = [(i, f"question {'why ' * (i % 7)}", f" answer {'because ' * (i % 11 + 1)}") for i in range(60)]
    rows = [(i, q + a, [(len(q), len(q + a))]) for i, q, a in texts] + [(60, "plain text", None), (61, "no loss", []), (62, None, [(0, 3)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<begin:int,end:int>>").coalesce(1)
    limits = packing.Limits(tokens=64, segments=8, loss=20)
    got = packing.pack(df, path, 0, limits=limits, loss_spans="spans").collect()
    e = Encoder(path)
    encode = lambda text: e.encode([text])[0].tolist()
    ids = {i: [*encode(q), *encode(a), 0] for i, q, a in texts} | {60: [*encode("plain text"), 0], 61: [*encode("no loss"), 0], 62: [0]}
    bears = {i: [0] * len(encode(q)) + [1] * (len(encode(a)) + 1) for i, q, a in texts} | {60: [1] * len(ids[60]), 61: [0] * len(ids[61]), 62: [0]}
    sequences, seen = {}, {i: [] for i in ids}
    for r in got:
        assert r.loss_tokens == sum(bears[r.doc_id][r.start + 1 : r.start + r.length])
        seen[r.doc_id] += [(r.start, np.frombuffer(r.ids, "<u4").tolist())]
        sequences.setdefault(r.sequence_id, []).append(r)
    assert {i: sum((x for _, x in sorted(v)), []) for i, v in seen.items()} == ids
    assert all(sum(r.loss_tokens for r in s) <= 20 and sum(r.length for r in s) <= 64 and len(s) <= 8 for s in sequences.values())
    assert any(sum(r.loss_tokens for r in s) >= 18 and sum(r.length for r in s) < 60 for s in sequences.values())


def test_segments():
    from strataloom.llm.packing import segments

    span = lambda *p: [{"begin": a, "end": b} for a, b in p]
    assert segments("abcdef", span((3, 5), (1, 3))) == (["a", "bcde", "f"], [False, True, False])
    assert segments("abc", span((0, 9), (1, 2))) == (["abc"], [True])
    assert segments("abc", []) == (["abc"], [False]) and segments(None, span((0, 1))) == ([], [])


def test_every_label_is_a_class(spark):
    from strataloom.llm import langid

    words = {"aa": "lorem ipsum dolor", "bb": "schnell grüße straße", "cc": "zyx wvu tsr", "dd": "kappa omega sigma", "ee": "один два три"}
    docs = spark.createDataFrame([(i * 10 + j, w, lang) for i, (lang, w) in enumerate(words.items()) for j in range(8 - i)], "doc_id long, text string, lang string")
    one, cut = langid.train(docs), langid.train(docs, classes=2)
    assert one.classes == cut.classes == sorted(words)
    assert (one.table == cut.table).all()
    assert cut.predict(list(words.values()))[0] == list(words)
