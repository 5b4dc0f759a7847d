"""Collocations: phrases whose words occur together more often than apart.

Identical pieces of text become one row with a multiplicity.  Weighted n-grams
are counted by hash bucket, out of core, in duckdb.  A frequent phrase has only
frequent phrases inside, so sizes are counted one after another: as packed
64-bit hashes first, whose totals can only be too high, and then, for what
reaches the limit, as strings, whose totals are exact.  The counts of the parts
of a phrase are looked up by requests that are shuffled to where they lie.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bits import BitMap
from ._common import slices, small_batches, stored, table
from .decontaminate import Words, parts

#: Words of a phrase, its least count, and phrases a language reports.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A candidate goes if a longer one has at least so many hundredths of its count.
SHARE = 100
#: UTF-8 bytes of distinct pieces that a task holds before it passes them on.
HELD_BYTES = 16 << 20
#: Bytes of pieces whose n-grams are made at a time; hashes, or strings, that a task gathers.
PART = 1 << 20
GATHERED = 1 << 21
STRINGS = 300_000
#: Memory of duckdb in a task; beyond that it writes to scratch files.
MEMORY = "256MB"
#: Hash buckets at least, and shares into which requests for one part are dealt.
BUCKETS, SALT = 256, 8

#: A-Z become a-z, the marks and line ends between pieces ``\n``, the tab a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_SPACES = re.compile(rb" {2,}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def text_pieces(text: str | None) -> list[bytes]:
    """The pieces of a text that have words, with one space between words."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    raw = _SPACES.sub(b" ", raw) if b"  " in raw else raw
    return [p for x in raw.split(b"\n") if (p := x.strip(b" "))]


def distinct_pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, words, times): each distinct piece of a language once, with how often it occurs."""
    small_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))

    def run(batches):
        held: dict[tuple[str, bytes], int] = {}
        size = 0

        def batch():
            langs, found = zip(*held) if held else ((), ())
            cols = [pa.array(langs, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array([p.count(b" ") + 1 for p in found], pa.int64()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "piece", "words", "times"])

        for b in slices(batches, 1):
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p in text_pieces(t):
                    key = (l, p)
                    if (n := held.get(key)) is None:
                        held[key] = 1
                        size += len(p)
                    else:
                        held[key] = n + 1
                if size > HELD_BYTES:
                    yield batch()
                    held, size = {}, 0
        yield batch()

    made = own.mapInArrow(run, "lang string, piece string, words bigint, times bigint")
    return made.groupBy("lang", "piece", "words").agg(F.sum("times").alias("times"))


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Grams:
    """The n-grams of some (parts of) pieces, as hashes that tell languages apart.

    Piece i is of language ``names[codes[i]]``, occurs ``times[i]`` times, and its
    first ``repeated`` words belong to the part before it.
    """

    def __init__(self, pieces: list[bytes], names: list[str], codes: np.ndarray, times: np.ndarray, repeated: int = 0):
        self.words, self.names = Words(pieces), names
        piece = self.words.piece
        self.lang = codes[piece]
        self.seed = np.array([_seed(n) for n in names], dtype=np.uint64)[self.lang]
        self.times = times[piece]
        # The first word of each piece that is new.
        self.old = (self.words.first[:-1] + repeated)[piece]

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams from each word on, and which of them exist and are new here."""
        h, one = self.words.grams(k)
        n = len(h)
        h = (h ^ self.seed[:n]) * _MIX
        return h ^ (h >> np.uint64(32)), one & (np.arange(n) + k > self.old[:n])

    def frequent(self, inner: int, known: BitMap) -> np.ndarray:
        """Whether the n-gram of ``inner`` words from each word on may be frequent; also where it is not new."""
        h, _ = self.of(inner)
        _, one = self.words.grams(inner)
        out = np.zeros(len(h), dtype=bool)
        at = np.flatnonzero(one)
        out[at] = known.passes(h[at])
        return out

    def strings(self, at: np.ndarray, k: int) -> pa.Array:
        """The n-grams of k words from these words on."""
        starts, ends = self.words.starts[at], self.words.ends[at + k - 1]
        n = ends - starts
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        raw = np.frombuffer(self.words.data, dtype=np.uint8)[np.repeat(starts - offsets[:-1], n) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _grouped(batches, longest: int):
    """``Grams`` of at most about ``PART`` bytes of pieces; a longer piece goes in parts that overlap."""
    for b in slices(batches, 1, limit=PART, rows=1 << 16):
        langs = b.column(0).dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        times, raw = b.column(2).to_numpy(), b.column(1).cast(pa.binary()).to_pylist()
        if len(raw) == 1:
            for i, (part, _) in enumerate(parts(raw[0], longest - 1)):
                # One space where the part was put behind the words repeated.
                yield Grams([part.replace(b"  ", b" ")], names, codes, times, longest - 1 if i else 0)
        else:
            yield Grams(raw, names, codes, times)


def _counted(batches, columns: list[str], least: int):
    """Sums of ``times`` by the other columns, at least ``least``, by duckdb with bounded memory.

    Its scratch files are the task's own, like the files that Spark's operators
    spill: nothing else reads them, and they go when the task ends.
    """
    import duckdb

    batches = iter(batches)
    if (first := next(batches, None)) is None:
        return
    with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as db:

        def all_():
            yield first
            yield from batches

        rows = pa.RecordBatchReader.from_batches(first.schema, all_())  # noqa: F841 - read by name
        keys = ", ".join(columns)
        yield from db.sql(f"select {keys}, sum(times)::bigint as times from rows group by {keys} having sum(times) >= {least}").to_arrow_reader(1 << 16)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _buckets(spark: SparkSession) -> int:
    """A task sends a row a bucket, so they are no more than the partitions need."""
    return max(BUCKETS, _partitions(spark))


def may_be_frequent(pieces: DataFrame, sizes: list[int], inner: int, known: BitMap | None, least: int, longest: int) -> DataFrame:
    """(gram): hashes of n-grams of these sizes whose total reaches ``least``.

    Only n-grams whose inner n-grams of ``inner`` words pass ``known`` are counted.
    Two n-grams of one hash are counted together, so none that is frequent is
    missing.  A task's totals are cut at ``least``, which decides the same.
    """
    buckets = _buckets(pieces.sparkSession)
    kind = np.dtype("<u2" if least < 1 << 16 else "<u8")
    width = np.uint64(-(-(1 << 64) // buckets))

    def gather(batches):
        hashes, times, held = [], [], 0

        def send():
            h, t = np.concatenate(hashes), np.concatenate(times)
            order = np.argsort(h)
            h, t = h[order], t[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            h, t = h[first], np.minimum(np.add.reduceat(t, first), least).astype(kind)
            bucket = (h // width).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            for i in range(0, len(spans), 256):
                some = spans[i : i + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[a]) for a, _ in some], pa.int64()), pa.array([h[a:z].tobytes() for a, z in some], pa.binary()), pa.array([t[a:z].tobytes() for a, z in some], pa.binary())],
                    names=["bucket", "hashes", "times"],
                )

        for g in _grouped(batches, longest):
            ok = g.frequent(inner, known) if known else None
            for k in sizes:
                h, new = g.of(k)
                if ok is not None:
                    for j in range(k - inner + 1):
                        new = new & ok[j : j + len(new)]
                at = np.flatnonzero(new)
                if len(at):
                    hashes.append(h[at])
                    times.append(g.times[at])
                    held += len(at)
            if held > GATHERED:
                yield from send()
                hashes, times, held = [], [], 0
        if held:
            yield from send()

    def unpack(batches):
        for b in batches:
            for h, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, "<i8")), pa.array(np.frombuffer(t, kind).astype(np.int64))], names=["gram", "times"])

    def count(batches):
        for b in _counted(unpack(batches), ["gram"], least):
            yield b.select(["gram"])

    sent = pieces.select("lang", "piece", "times").mapInArrow(gather, "bucket bigint, hashes binary, times binary")
    return sent.repartition(_partitions(pieces.sparkSession), "bucket").mapInArrow(count, "gram bigint")


def frequent_phrases(pieces: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, times): all phrases of 1 to ``longest`` words with at least ``least`` occurrences, exactly."""
    spark = pieces.sparkSession
    known: dict[int, BitMap] = {}
    for sizes in ([1], [2], list(range(3, longest + 1))):
        if sizes and sizes[0] <= longest:
            inner = min(sizes[0] - 1, 2)
            found = may_be_frequent(pieces, sizes, inner, known.get(inner), least, longest)
            known |= dict.fromkeys(sizes, BitMap(stored(found, "frequent-hashes")))

    buckets = _buckets(spark)

    def gather(batches):
        held: dict[tuple[str, int, bytes], int] = {}

        def send():
            """A row a bucket: its phrases and their counts as an Arrow stream."""
            langs, sizes, found = zip(*held)
            cols = [pa.array(langs, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(held.values(), pa.int64())]
            bucket = np.fromiter((zlib.crc32(p, zlib.crc32(l.encode())) % buckets for l, _, p in held), dtype=np.int64, count=len(held))
            order = np.argsort(bucket, kind="stable")
            rows, bucket = pa.RecordBatch.from_arrays(cols, names=["lang", "phrase", "words", "times"]).take(pa.array(order)), bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()
            packed = []
            for a, z in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows.slice(a, z - a))
                packed.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(packed, pa.binary())], names=["bucket", "rows"])

        for g in _grouped(batches, longest):
            names = g.names
            for k in range(1, longest + 1):
                h, new = g.of(k)
                at = np.flatnonzero(new)
                at = at[known[k].passes(h[at])]
                if not len(at):
                    continue
                coded = g.strings(at, k).dictionary_encode()
                n = len(coded.dictionary)
                # A string may occur in several languages: count by (language, string).
                where = g.lang[at].astype(np.int64) * n + coded.indices.to_numpy()
                total = np.zeros(n * len(names), dtype=np.int64)
                np.add.at(total, where, g.times[at])
                strings = coded.dictionary.to_pylist()
                for i in np.flatnonzero(total).tolist():
                    key = (names[i // n], k, strings[i % n])
                    held[key] = held.get(key, 0) + int(total[i])
            if len(held) > STRINGS:
                yield send()
                held = {}
        if held:
            yield send()

    def unpack(batches):
        for b in batches:
            for packed in b.column(1).to_pylist():
                yield from pa.ipc.open_stream(packed)

    def count(batches):
        yield from _counted(unpack(batches), ["lang", "phrase", "words"], least)

    sent = pieces.select("lang", "piece", "times").mapInArrow(gather, "bucket bigint, rows binary")
    return sent.repartition(_partitions(spark), "bucket").mapInArrow(count, "lang string, phrase string, words int, times bigint")


def _scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two words or more, by their lowest-scoring cut."""
    cuts = grams.where("words > 1").select("lang", "phrase", F.col("times").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("part")), F.struct(F.lit(1).alias("side"), F.expr("substring(phrase, length(first) + 2)").alias("part"))))
    requests = cuts.withColumn("side", sides).select("lang", "phrase", "a", "cut", "side.side", "side.part", F.pmod(F.xxhash64("phrase"), F.lit(SALT)).alias("salt"))
    # Requests for one part are dealt into shares, each with a copy of the count.
    counts = grams.select("lang", F.col("phrase").alias("part"), "times", F.explode(F.expr(f"sequence(0L, {SALT - 1}L)")).alias("salt"))
    replies = requests.join(counts, ["lang", "part", "salt"]).repartition("lang", "phrase")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("times")))
    both = replies.groupBy("lang", "phrase", "a", "cut").agg(of(0).alias("l"), of(1).alias("r")).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumns({"over": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "under": wide("l") * wide("r")}).withColumn("score", F.expr("over div under"))
    best = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def _covered(grams: DataFrame) -> DataFrame:
    """(lang, phrase, most): what lies inside longer candidates, with the largest count of these."""
    long = grams.where("words > 2").select("lang", "words", "times", F.split("phrase", " ", -1).alias("w"))
    sized = long.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    placed = sized.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("at"))
    return placed.select("lang", "times", F.array_join(F.slice("w", F.col("at"), F.col("k")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("times").alias("most"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts, A-Z lower-cased, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
    these at spaces and tabs into words.  Phrases of 2 to ``longest`` words with
    a >= ``least`` occurrences within pieces are candidates; their score is
    floor(1000 a n / (l r)) at the cut where that is lowest (ties: the first
    cut), with the counts l and r of the two parts and n of all words.  A
    candidate goes if a longer candidate that has it inside occurs at least
    ``share`` hundredths as often.  Order: score, a, descending, then phrase.

    A null text has no words; a null language is ``und``; a word may be of any
    length; equal pieces are counted once and weighted; repeated rows count each;
    no rows give no rows; other columns are ignored.  A long text costs a few
    copies of itself, its n-grams are made in parts.
    """
    pieces = stored(distinct_pieces(docs, text, lang), "pieces")
    totals = pieces.groupBy("lang").agg(F.sum(F.col("words") * F.col("times")).alias("n"))
    grams = stored(frequent_phrases(pieces, longest, least), "phrases")
    kept = _scored(grams, totals).join(_covered(grams), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each share of a language, then the best of these.
    shares = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language; see ``collocations`` for nulls, ties and repeats."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op13_phrase_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
sizes as (select unnest([1, 2, 3, 4, 5]) as k),
places as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, sizes where len(w) >= k),
grams as materialized (
  select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as phrase, count(*)::bigint as f from places group by all having count(*) >= 100),
cuts as (
  select lang, phrase, f as a, c, array_to_string(list_slice(w, 1, c), ' ') as p, array_to_string(list_slice(w, c + 1, k), ' ') as q
  from (select *, string_split(phrase, ' ') as w, unnest(range(1, k)) as c from grams where k > 1)),
scored as (
  select c.lang, c.phrase, c.a, c.c, x.f as l, y.f as r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score
  from cuts c join grams x on x.lang = c.lang and x.phrase = c.p join grams y on y.lang = c.lang and y.phrase = c.q join totals t on t.lang = c.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (
  select lang, array_to_string(list_slice(w, i, i + m - 1), ' ') as phrase, max(f) as most
  from (select lang, w, f, m, unnest(range(1, k - m + 2)) as i from (select *, string_split(phrase, ' ') as w, unnest(range(2, k)) as m from grams where k > 2))
  group by all),
kept as (select l.* from lowest l left join inside i using (lang, phrase) where most is null or 100 * most < 100 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= 2000
"""
}
