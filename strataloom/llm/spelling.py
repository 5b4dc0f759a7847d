"""Spelling variants grouped by full neighbourhood generation.

Every vocabulary word emits all distinct strings that one deletion, replacement
or insertion over the observed alphabet makes of it.  A string that is itself a
vocabulary word is a near word, so candidates are joined to the vocabulary by
hash and nothing is left to verify.  Candidates are numbers (64-bit hashes that
numpy derives from the word's prefix sums) until a bit map of the vocabulary,
of bounded size, lets one pass; only then is the string made and shuffled, so
what is shuffled grows with the near pairs and not with the neighbourhood.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bits import BitMap
from ._common import discard, slices, small_batches, stored, table

#: Code points of a word, and occurrences, that make it a vocabulary word.
SHORTEST, LEAST = 6, 5
#: How many times more frequent a word's form has to be.
FACTOR = 5
#: An occurrence whose hash this divides loses a code point.
DIVISOR = 199
#: Distinct words that a task counts before it passes them on.
HELD = 300_000
#: Characters of a text that are worked on at a time.
PART = 1 << 20
#: Positions of words whose neighbourhoods are made at a time.
POSITIONS = 1 << 13
#: Words of at most so many UTF-8 bytes have their hash composed in numpy.
COMPOSED = 64

#: Letters stay, A-Z are lower-cased, all else becomes a space; one byte a code
#: point (Latin-1), for every letter of the pattern is below U+0100.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9DDFEA08EB382D69


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


_CRC = _crc_table()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _weights() -> np.ndarray:
    """A fixed number per letter; none for the space that ends a word."""
    out = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX)
    out[32] = 0
    return out


_WEIGHT = _weights()


def latin(text: str | None) -> bytes:
    """The lower-cased runs of a text, one byte a code point, with spaces between."""
    return (text or "").encode("latin-1", "replace").translate(_TABLE)


def _parts(raw: bytes):
    """The runs in parts of about ``PART`` bytes; a longer run stays whole."""
    at = 0
    while len(raw) - at > PART and (stop := raw.find(b" ", at + PART)) >= 0:
        yield raw[at:stop]
        at = stop
    yield raw[at:] if at else raw


def _groups(parts):
    """Lists of (document, part) of about ``PART`` bytes."""
    group, size = [], 0
    for doc, part in parts:
        if group and size + len(part) > PART:
            yield group
            group, size = [], 0
        group.append((doc, part))
        size += len(part)
    if group:
        yield group


def occurrences(group: list[tuple[int, bytes]], prefixes: list[bytes], divisor: int) -> dict[bytes, int]:
    """How often each word occurs in some parts, after the marked occurrences lost a code point.

    The CRC-32 of two strings put together is that of the first, moved over as
    many zero bytes as the second has, combined with that of the second.  So
    each distinct run and each document is hashed once, and numpy combines them.
    """
    raw = np.frombuffer(b" ".join([p for _, p in group]), dtype=np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return {}
    length = ends - starts
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = runs.dictionary_encode()
    which, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    spelled = [w.decode("latin-1").encode() for w in words]
    own = np.fromiter(map(zlib.crc32, spelled), dtype=np.uint32, count=len(words))
    size = np.fromiter(map(len, spelled), dtype=np.int64, count=len(words))

    sizes = np.fromiter((len(p) + 1 for _, p in group), dtype=np.int64, count=len(group))
    at = np.searchsorted(np.cumsum(sizes), starts, side="right")  # the part of each run
    moved = np.empty((COMPOSED + 1, len(group)), dtype=np.uint32)
    moved[0] = [zlib.crc32(prefixes[doc]) for doc, _ in group]
    for k in range(COMPOSED):
        moved[k + 1] = (moved[k] >> np.uint32(8)) ^ _CRC[moved[k] & np.uint32(255)]
    n_bytes = size[which]
    h = moved[np.minimum(n_bytes, COMPOSED), at] ^ own[which]
    for i in np.flatnonzero(n_bytes > COMPOSED).tolist():
        h[i] = zlib.crc32(spelled[which[i]], zlib.crc32(prefixes[group[at[i]][0]]))

    changed = np.flatnonzero(h % np.uint32(divisor) == 0)
    n = np.bincount(which, minlength=len(words)) - np.bincount(which[changed], minlength=len(words))
    out = {w: k for w, k in zip(words, n.tolist()) if k}
    for i, hash_ in zip(which[changed].tolist(), h[changed].tolist()):
        w = words[i]
        place = hash_ % len(w)
        w = w[:place] + w[place + 1 :]
        out[w] = out.get(w, 0) + 1
    return out


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, divisor: int = DIVISOR) -> DataFrame:
    """(word, n): the words of at least ``shortest`` code points with at least ``least`` occurrences.

    A word is a maximal run ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased, that loses
    the code point ``h % length`` where ``divisor`` divides h, the CRC-32 of
    ``<id>:<run>``.  Null and empty texts have no words; a null id reads as an
    empty one; repeated rows count as often as they occur; no rows give no
    words; other columns are ignored.  Long texts are counted in parts.  Tasks
    count before the shuffle, so a frequent word is a row a task.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))

    def run(batches):
        held: dict[bytes, int] = {}

        def flush():
            words = [w.decode("latin-1") for w in held]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()

        for b in slices(batches, 1):
            prefixes = [f"{i}:".encode() for i in b.column(0).to_pylist()]
            texts = b.column(1).to_pylist()
            for group in _groups((i, p) for i, t in enumerate(texts) if t for p in _parts(latin(t))):
                for w, k in occurrences(group, prefixes, divisor).items():
                    if len(w) >= shortest:
                        held[w] = held.get(w, 0) + k
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    return own.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Neighbourhood:
    """The hashes of words (Latin-1 bytes) and of all that one edit makes of them.

    A word's hash is a sum of its letters' weights times powers of an odd base,
    so an edit changes it by what lies before, at and behind the place.
    """

    def __init__(self, words: list[bytes]):
        self.words = words
        self.flat = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)  # a word's end is a place too
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        first = np.cumsum(size) - size
        self.owner = np.repeat(np.arange(len(words)), size)
        self.place = np.arange(len(self.flat)) - first[self.owner]
        powers = np.concatenate((np.ones(1, dtype=np.uint64), np.cumprod(np.full(int(size.max(initial=1)), _BASE, dtype=np.uint64))))
        self.power = powers[self.place]
        own = _WEIGHT[self.flat] * self.power
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(own)))
        before = sums[:-1] - sums[first][self.owner]
        whole = (sums[first + size] - sums[first])[self.owner]
        self.hash = mixed(whole[first]) if len(words) else np.empty(0, dtype=np.uint64)
        behind = whole - before - own
        self.without = before + behind * np.uint64(pow(_BASE, -1, 1 << 64))
        self.replaced = whole - own
        self.pushed = before + (whole - before) * np.uint64(_BASE)
        #: The letter before each place; none at the beginning of a word.
        self.last = np.where(self.place > 0, np.concatenate((np.zeros(1, dtype=np.uint8), self.flat[:-1])), 0)

    def candidates(self, alphabet: np.ndarray, passes):
        """Arrays (place, letter or -1, kind) of the distinct edits whose hash ``passes``.

        Of equal results one is made: the deletion of the first of equal letters,
        and the insertion in front of them.
        """
        for a in range(0, len(self.flat), POSITIONS):
            here = slice(a, a + POSITIONS)
            flat, last = self.flat[here], self.last[here]
            real = flat != 32
            k = np.flatnonzero(real & (flat != last))
            yield a + (k := k[passes(mixed(self.without[here][k]))]), np.full(len(k), -1), "delete"
            new = _WEIGHT[alphabet] * self.power[here][:, None]
            for kind, base, allowed in (
                ("replace", self.replaced, real[:, None] & (flat[:, None] != alphabet)),
                ("insert", self.pushed, last[:, None] != alphabet),
            ):
                at, letter = np.nonzero(allowed)
                ok = passes(mixed(base[here][at] + new[at, letter]))
                yield a + at[ok], alphabet[letter[ok]], kind

    def spell(self, place: int, letter: int, kind: str) -> bytes:
        w, i = self.words[self.owner[place]], int(self.place[place])
        return w[:i] + (b"" if kind == "delete" else bytes((letter,))) + w[i + (kind != "insert") :]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near): for each string that is one edit from vocabulary words, their number and the best.

    ``near`` is a struct (less, word) of the most frequent, the smallest in
    code-point order among equals; ``less`` is minus its n.  Strings that are no
    words and slipped through the bit map are there too: join them to ``words``.
    """
    spark = words.sparkSession
    # One row a letter: at most the 90 of the pattern.
    letters = words.select(F.explode(F.split("word", "")).alias("c")).distinct().where("c <> ''").collect()
    alphabet = np.array(sorted(ord(r.c) for r in letters), dtype=np.uint8)

    def hashes(batches):
        for b in slices(batches, 0):
            h = Neighbourhood([w.encode("latin-1") for w in b.column(0).to_pylist()]).hash
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["gram"])

    known = BitMap(stored(words.select("word").mapInArrow(hashes, "gram bigint"), "word-hashes"))

    def run(batches):
        for b in slices(batches, 0, limit=PART // 16):
            own, n = b.column(0).to_pylist(), b.column(1).to_pylist()
            around = Neighbourhood([w.encode("latin-1") for w in own])
            for place, letter, kind in around.candidates(alphabet, known.passes):
                if len(place):
                    owner = around.owner[place].tolist()
                    strings = [around.spell(p, c, kind).decode("latin-1") for p, c in zip(place.tolist(), letter.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(strings, pa.string()), pa.array([own[i] for i in owner], pa.string()), pa.array([n[i] for i in owner], pa.int64())],
                        names=["word", "of", "n"],
                    )

    made = words.select("word", "n").mapInArrow(run, "word string, of string, n bigint")
    return made.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("of").alias("word"))).alias("near"))


def roots(links: DataFrame) -> DataFrame:
    """(word, at): the last word of the chain that starts with a link (word, at).

    Links lead to a more frequent word, so there are no rings; every round
    follows twice as many links, so a chain of m takes log2(m) rounds.
    """
    links = stored(links, "links")
    while True:
        ahead = links.select(F.col("word").alias("at"), F.col("at").alias("further"))
        moved = stored(links.join(ahead, "at", "left").select("word", F.coalesce("further", "at").alias("at"), F.col("further").isNotNull().alias("moved")), "links")
        done = moved.where("moved").isEmpty()
        discard(links)
        links = moved.select("word", "at")
        if done:
            return links


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, factor: int = FACTOR, divisor: int = DIVISOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all vocabulary words (see ``vocabulary``).

    Two words are near if exactly one code point inserted, deleted or replaced
    makes one of the other.  A word's form is its near word of largest n (ties:
    the smallest in code-point order) if that n is at least ``factor`` times its
    own, else null; its root is the end of the chain of forms.  n_near is 0 for a
    word without near words.  ``factor`` has to be above 1.
    """
    if factor <= 1:
        raise ValueError("factor has to be above 1")
    words = stored(vocabulary(docs, doc_id, text, shortest, least, divisor), "vocabulary")
    best = words.join(near_words(words), "word", "left")
    form = F.when(-F.col("near.less") >= factor * F.col("n"), F.col("near"))
    forms = stored(
        best.withColumn("form", form).select("word", F.col("form.word").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("form.less")).alias("form_n")),
        "forms",
    )
    ends = roots(forms.where("form is not null").select("word", F.col("form").alias("at")))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("at", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of at least 6 code points and 5 occurrences in whole texts.

    Null and empty texts have no words, an empty table gives no rows, repeated
    rows count each, ties go to the smallest word, other columns are ignored,
    and long texts are counted in parts.
    """
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The CRC-32 is put together from a table of what a byte with so many bytes
#: behind it gives; near words come from deletions and from words with a gap.
ORACLE_SQL = {
    "op11_spelling_variants": r"""
with recursive crc(b, v) as materialized (
  select i, list_reduce([i::bigint] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) from range(256) t(i)),
runs as materialized (
  select doc_id, run, count(*) as k from (
    select doc_id, unnest(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-zÀ-ÿ]', ' ', 'g'), '[^ ]+')) as run from documents)
  group by all),
texts as materialized (
  select doc_id, run, k, concat(doc_id, ':', run) as s, strlen(concat(doc_id, ':', run)) as m from runs),
longest as (select max(m) as m from texts),
tail(d, b, v) as (
  select 0, b, v from crc
  union all
  select t.d + 1, t.b, xor(t.v >> 8, c.v) from tail t join crc c on c.b = t.v & 255, longest l where t.d + 1 < l.m),
zeros(m, v) as (
  select 0, 4294967295::bigint
  union all
  select z.m + 1, xor(z.v >> 8, c.v) from zeros z join crc c on c.b = z.v & 255, longest l where z.m < l.m),
bytes as (
  select doc_id, run, m, m - i as d, ('0x' || substr(h, 2 * i - 1, 2))::int as b
  from (select doc_id, run, m, hex(encode(s)) as h, unnest(range(1, m + 1)) as i from texts)),
hashes as (
  select x.doc_id, x.run, xor(bit_xor(t.v), xor(any_value(z.v), 4294967295)) as h
  from bytes x join tail t on t.d = x.d and t.b = x.b join zeros z on z.m = x.m group by x.doc_id, x.run),
words as materialized (
  select word, sum(k)::bigint as n from (
    select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k
    from runs join hashes using (doc_id, run))
  where length(word) >= 6 group by word having sum(k) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
deleted as (select distinct word, n, left(word, i - 1) || substr(word, i + 1) as s from places),
gaps as (select word, n, left(word, i - 1) || ' ' || substr(word, i + 1) as s from places),
near as (
  select d.word, w.word as other, w.n as m from deleted d join words w on w.word = d.s
  union all
  select w.word, d.word, d.n from deleted d join words w on w.word = d.s
  union all
  select a.word, b.word, b.n from gaps a join gaps b on a.s = b.s and a.word <> b.word),
best as (
  select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from near group by word),
forms as materialized (
  select w.word, case when m >= 5 * w.n then other end as form, w.n, coalesce(n_near, 0) as n_near, case when m >= 5 * w.n then m end as form_n
  from words w left join best using (word)),
chain(word, now) as (
  select word, word from forms
  union all
  select c.word, f.form from chain c join forms f on f.word = c.now where f.form is not null),
ends as (select c.word, c.now from chain c join forms f on f.word = c.now where f.form is null)
select f.word, f.form, e.now as root, f.n, f.n_near, f.form_n from forms f join ends e using (word)
"""
}
