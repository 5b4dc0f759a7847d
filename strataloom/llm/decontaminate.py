"""Benchmark decontamination by winnowing, as one join.

Of every window of w consecutive k-grams the smallest hash is kept (the
rightmost of equals).  A window of w + k - 1 words therefore keeps one k-gram,
and two equal windows keep the same one.  With k = 5 and w = 6 that is every
window of 10 words, the span asked for.

Kept k-grams of documents and of the benchmark are joined.  A hit is extended to
the whole windows that kept the k-gram: the join compares the digest of the
window's words too, so what is joined is equal, and a k-gram that half of all
texts have meets nothing but equal windows.  Windows that overlap are one span.
Items shorter than a window have no such guarantee; their whole word sequences
are looked up at every position instead.

One pass over the texts finds the kept k-grams whatever the benchmark's size: a
bit map of the benchmark's hashes, of at most ``2**MOST_BITS`` bits, is broadcast,
and only windows that pass it are written and joined.  A bit map that fills up
lets more windows pass; it never loses one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, slices, small_batches, stored, table

WINDOW = 10
GRAM = 5
#: The broadcast bit map has 32 bits or more a window of the benchmark, but never more than 32 MB.
LEAST_BITS, MOST_BITS = 20, 28
#: Contaminated texts whose keys may be broadcast (48 bytes each).
BROADCAST_KEYS = 1 << 18
#: Bytes of a long text that are worked on at a time.
PART = 1 << 20

#: Bytes that are no word bytes (``[\x00-\x2F\x3A-\x60\x7B-\x7F]``) become
#: spaces; A-Z are lower-cased before.
_SPACES = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9DDFEA08EB382D69
CANDIDATES = "array<struct<gram:bigint,digest:binary,spans:array<struct<start:bigint,stop:bigint>>>>"
FOUND = "struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>>"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_CANDIDATE = pa.list_(pa.struct([("gram", pa.int64()), ("digest", pa.binary()), ("spans", pa.list_(_SPAN))]))

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def plain(text: str | None) -> bytes:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased, with spaces between; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES)


def parts(raw: bytes, overlap: int = WINDOW - 1):
    """(bytes, words before them) of about ``PART`` bytes; each part repeats the last ``overlap`` words."""
    at, carry, before = 0, b"", 0
    while len(raw) - at > PART and (stop := raw.find(b" ", at + PART)) >= 0:
        piece = carry + b" " + raw[at:stop] if carry else raw[at:stop]
        yield piece, before
        last = piece.rsplit(maxsplit=overlap)[-overlap:]
        before += len(piece.split()) - len(last)
        carry, at = b" ".join(last), stop
    yield carry + b" " + raw[at:] if carry else raw[at:], before


class Words:
    """The words of several byte strings in arrays."""

    def __init__(self, pieces: list[bytes]):
        self.data = b" ".join(pieces)
        raw = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.concatenate(([False], raw != 32, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + 1
        #: The first word of each piece, and the number of words.
        self.first = np.append(np.searchsorted(self.starts, np.cumsum(lengths) - lengths), len(self.starts))
        self.piece = np.repeat(np.arange(len(pieces)), np.diff(self.first))
        self.hashes = self._hashes(raw)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        """A number per word that equal words share: a polynomial in its bytes, mixed."""
        if len(_powers[0]) <= len(raw):
            n = 1 << len(raw).bit_length()
            for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                _powers[i] = np.concatenate((np.ones(1, dtype=np.uint64), np.cumprod(np.full(n, base, dtype=np.uint64))))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw + np.uint64(1)) * _powers[0][: len(raw)])))
        h = (sums[self.ends] - sums[self.starts]) * _powers[1][self.starts]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the k words from each word on, and whether they are of one piece."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        h = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            h = (h ^ self.hashes[j : j + n]) * _MIX
            h ^= h >> np.uint64(29)
        return h, self.piece[:n] == self.piece[k - 1 :]

    def digest(self, at: int, k: int) -> bytes:
        """A name of the k words from ``at`` on that no other words have."""
        data, starts, ends = self.data, self.starts, self.ends
        return hashlib.blake2b(b" ".join([data[a:b] for a, b in zip(starts[at : at + k].tolist(), ends[at : at + k].tolist())]), digest_size=16).digest()


def kept(h: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """The place of the rightmost smallest of the w hashes from each start on."""
    out = np.empty(len(starts), dtype=np.int64)
    for i in range(0, len(starts), 1 << 14):  # bounded temporary
        s = starts[i : i + (1 << 14)]
        out[i : i + len(s)] = s + w - 1 - h[s[:, None] + np.arange(w - 1, -1, -1)].argmin(axis=1)
    return out


def _signed(h: np.ndarray) -> list[int]:
    return h.view(np.int64).tolist()


def item_windows(text: str | None, window: int, gram: int) -> set[tuple[int, int, bytes]]:
    """(words, kept hash, digest) of the windows of an item; one of fewer words is one window."""
    out = set()
    pieces = list(parts(plain(text), window - 1))
    for i, (piece, before) in enumerate(pieces):
        words = Words([piece])
        n = len(words.hashes)
        if n >= window:
            h, _ = words.grams(gram)
            starts = np.arange(n - window + 1)
            chosen = h[kept(h, starts, window - gram + 1)]
            out |= {(window, g, words.digest(s, window)) for s, g in zip(starts.tolist(), _signed(chosen))}
        elif n and not before and i == len(pieces) - 1:
            h, _ = words.grams(n)
            out.add((n, _signed(h)[0], words.digest(0, n)))
    return out


def candidates(words: Words, passes, lengths: list[int], window: int, gram: int):
    """(piece, first word, words, hash, digest) of windows whose kept hash ``passes``."""
    w = window - gram + 1
    if window in lengths:
        h, one = words.grams(gram)
        hit = np.flatnonzero(one & passes(h)) if len(h) else np.empty(0, dtype=np.int64)
        for i in range(0, len(hit), 1 << 12):  # bounded temporary
            p = hit[i : i + (1 << 12)]
            s = (p[:, None] - np.arange(w - 1, -1, -1)).ravel()  # the windows that may have kept it
            p = np.repeat(p, w)
            inside = (s >= words.first[words.piece[p]]) & (s + window <= words.first[words.piece[p] + 1])
            s, p = s[inside], p[inside]
            own = kept(h, s, w) == p
            for at, g in zip(s[own].tolist(), _signed(h[p[own]])):
                yield int(words.piece[at]), at, window, g, words.digest(at, window)
    for m in lengths:
        if m < window:
            h, one = words.grams(m)
            if len(h):
                at = np.flatnonzero(one & passes(h))
                for a, g in zip(at.tolist(), _signed(h[at])):
                    yield int(words.piece[a]), a, m, g, words.digest(a, m)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that meet or overlap put together, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def fingerprints(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, rows: int | None = None) -> DataFrame:
    """Distinct (words, gram, digest, item): the windows of the benchmark, stored.

    A null id is an item named "null"; rows that repeat an id are one item; null
    texts and texts without words have no windows.  ``rows`` is about how many
    windows there are at most, if that is known.
    """
    own = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))

    def run(batches):
        for b in slices(batches, 1):
            rows = [(m, g, d, item) for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m, g, d in item_windows(t, window, gram)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.string()))], names=["words", "gram", "digest", "item"])

    return stored(own.mapInArrow(run, "words int, gram bigint, digest binary, item string").distinct(), "windows", rows)


def bit_map(windows: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """The hashes of the benchmark as a bit map in uint64: bounded by ``most_bits``, whatever their number.

    A hash sets two bits, told by its upper bits and by lower ones.
    """
    bits = int(min(most_bits, max(LEAST_BITS, (32 * windows.count()).bit_length())))
    place = F.explode(F.array(F.shiftrightunsigned("gram", 64 - bits), F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << bits) - 1))))
    bit = F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))")
    cells = windows.select(place.alias("place")).groupBy(F.shiftrightunsigned("place", 6).alias("cell")).agg(bit.alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[cells.column(0).to_numpy()] = cells.column(1).to_numpy().view(np.uint64)
    return out


def _scan(docs: DataFrame, windows: DataFrame, text: str, keep: list[str], window: int, gram: int, most_bits: int) -> tuple[DataFrame, str, str, str]:
    """The columns ``keep`` with a key of the text, its number of words and its candidate windows."""
    spark = docs.sparkSession
    small_batches(spark)
    key, n_words, found = (fresh(x, docs) for x in ("text_key", "n_words", "candidates"))
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.unhex(F.sha2(F.col(text), 256)).alias(key), F.col(text).alias(fresh("text_of", docs)))
    lengths = sorted(r.words for r in windows.select("words").distinct().collect())  # at most ``window`` numbers
    cells = bit_map(windows, most_bits)
    bits = len(cells).bit_length() - 1 + 6
    shift, mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
    shipped = spark.sparkContext.broadcast(cells)

    def run(batches):
        cells = shipped.value

        def is_set(place):
            return (cells[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

        def passes(h):
            out = is_set(h >> shift)
            hit = np.flatnonzero(out)
            out[hit] = is_set((h[hit] >> np.uint64(8)) & mask)
            return out

        index = len(keep) + 1
        for b in slices(batches, index, limit=PART // 2):
            pieces, owner, before = [], [], []
            for i, t in enumerate(b.column(index).to_pylist()):
                for piece, n in parts(plain(t), window - 1):
                    pieces.append(piece)
                    owner.append(i)
                    before.append(n)
            counts, hits = np.zeros(b.num_rows, dtype=np.int64), [{} for _ in range(b.num_rows)]
            for group in _groups(pieces):
                words = Words([pieces[j] for j in group])
                sizes = np.diff(words.first)
                for j, n in zip(group, sizes.tolist()):
                    counts[owner[j]] = before[j] + n  # the last part has them all
                for piece, at, m, g, d in candidates(words, passes, lengths, window, gram):
                    j = group[piece]
                    start = before[j] + at - int(words.first[piece])
                    hits[owner[j]].setdefault((g, d), []).append((start, start + m))
            values = [[{"gram": g, "digest": d, "spans": [{"start": x, "stop": y} for x, y in merged(spans)]} for (g, d), spans in h.items()] for h in hits]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(counts), pa.array(values, _CANDIDATE)], names=[*b.schema.names[:-1], n_words, found]
            )

    schema = own.drop(own.columns[-1]).select("*", F.lit(0).cast("long").alias(n_words), F.lit(None).cast(CANDIDATES).alias(found)).schema
    return own.mapInArrow(run, schema), key, n_words, found


def _groups(pieces: list[bytes]):
    """Numbers of pieces that are worked on together: about ``PART`` bytes."""
    group, size = [], 0
    for j, piece in enumerate(pieces):
        if group and size + len(piece) > PART:
            yield group
            group, size = [], 0
        group.append(j)
        size += len(piece)
    if group:
        yield group


def _hits(scanned: DataFrame, windows: DataFrame, key: str, found: str, rows: int | None = None) -> DataFrame:
    """(key, spans, items) of the texts that have a window of the benchmark, stored; ``rows``: of candidate windows."""
    # Equal texts have equal windows: one row per text goes on, combined on the map side.
    texts = scanned.where(F.size(found) > 0).select(F.col(key).alias("key"), F.col(found).alias("found")).groupBy("key").agg(F.first("found").alias("found"))
    own = texts.select("key", F.explode("found").alias("f")).select("key", "f.gram", "f.digest", "f.spans")
    own = stored(own, "candidates", rows)
    items = own.select("key", "gram", "digest").join(windows, ["gram", "digest"]).select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    spans = own.join(windows.select("gram", "digest").distinct(), ["gram", "digest"], "left_semi").groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batches):
        for b in batches:
            for key, spans in zip(b.column(0), b.column(1)):
                whole = [{"start": x, "stop": y} for x, y in merged([(s["start"], s["stop"]) for s in spans.as_py()])]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.binary()), pa.array([whole], pa.list_(_SPAN))], names=["key", "spans"])

    joined = spans.mapInArrow(run, "key binary, spans array<struct<start:bigint,stop:bigint>>")
    return stored(joined.join(items, "key"), "contaminated", rows)


def contamination(
    docs: DataFrame, benchmark: DataFrame, column: str | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, gram: int = GRAM, keep: list[str] | None = None, most_bits: int = MOST_BITS,
) -> DataFrame:
    """``docs`` with one more struct column (``column``, default "contamination").

    Fields: n_words; spans array<struct<start,stop>> of hit words, disjoint and
    ordered; items, the distinct ids (as text, sorted) of items with a window in
    the document.  A null or empty text has no words; an item without words, or
    an empty benchmark, never hits; a null item id counts as an item named
    "null"; rows of the benchmark that repeat an id are one item.  Every row of
    ``docs`` keeps its columns (or those of ``keep``), repeated rows and null ids
    included; no rows give no rows.  Long texts are worked on in parts.  The pass
    over the texts runs when this is called; its result is stored.
    """
    name = column or fresh("contamination", docs)
    keep = docs.columns if keep is None else keep
    windows = fingerprints(benchmark, item_id, item_text, window, gram)
    scan, key, n_words, found = _scan(docs, windows, text, keep, window, gram, most_bits)
    scanned = stored(scan, "scanned")
    hits = _hits(scanned, windows, key, found)

    def struct(spans, items):
        return F.struct(F.col(f"`{n_words}`").alias("n_words"), spans.alias("spans"), items.alias("items")).cast(FOUND).alias(name)

    own = [F.col(f"`{c}`") for c in keep]
    none = [F.array().cast("array<struct<start:bigint,stop:bigint>>"), F.array().cast("array<string>")]
    clean = scanned.where(F.size(found) == 0).select(*own, struct(*none))
    spans, items = fresh("spans", scanned), fresh("items", scanned)
    known = hits.select(F.col("key").alias(key), F.col("spans").alias(spans), F.col("items").alias(items))
    dirty = scanned.where(F.size(found) > 0).join(known, key, "left").select(*own, struct(F.coalesce(spans, none[0]), F.coalesce(items, none[1])))
    return clean.unionByName(dirty)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, gram: int = GRAM, most_bits: int = MOST_BITS, broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """The rows of ``docs`` without any hit word; columns as in ``docs``.

    Null and empty texts stay, and so does all with an empty benchmark; repeated
    rows share their fate; null ids do not matter; no rows give no rows.
    """
    # A word and its space are rarely less than four characters.
    words = (benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0) // 4
    windows = fingerprints(benchmark, item_id, item_text, window, gram, words)
    scan, key, _, found = _scan(docs, windows, text, [], window, gram, most_bits)
    scanned = stored(scan.where(F.size(found) > 0), "scanned")
    rows = scanned.agg(F.sum(F.size(found))).first()[0] or 0
    hits = _hits(scanned, windows, key, found, rows).select(F.col("key").alias(key))
    # Texts move only if the keys are too many to be sent to them.
    keys = F.broadcast(hits) if hits.count() <= broadcast_keys else hits
    return docs.withColumn(key, F.unhex(F.sha2(F.col(text), 256))).join(keys, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its hit words and the items that it has windows of.

    Null and empty texts have no words; repeated rows stay, with equal results;
    an empty table gives no rows; whole texts are read, long ones in parts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), "c", keep=["doc_id"])
    n_hit = F.aggregate("c.spans", F.lit(0).cast("long"), lambda acc, s: acc + s.stop - s.start)
    return found.select(
        "doc_id",
        F.col("c.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: Word windows by SQL alone: every window of an item, looked up in every document.
ORACLE_SQL = {
    "op8_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m
), hit AS (SELECT dw.doc_id, dw.i, dw.m, bw.item FROM dw JOIN bw USING (m, g)),
pos AS (SELECT DISTINCT doc_id, p FROM hit, unnest(range(i, i + m)) AS t(p)),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
