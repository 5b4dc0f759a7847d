"""SimHash near-duplicates by pigeonhole blocks.

64 bits are cut into six blocks.  Two fingerprints that differ in at most three
bits leave three blocks untouched, so they share one of the 20 choices of three
blocks (31 to 33 bits).  Fingerprints are joined on those keys and verified by
their Hamming distance.  Equal fingerprints are one node from the start, so a
group of exact copies never makes pairs.

A key with two fingerprints is settled by the aggregation itself.  A key with
more gives its members to one search that returns a star per connected group and
no pairs.  A key with more members than ``GROUP`` is cut again: its free bits
form eight blocks, of which five must agree, which leaves at most 13 free bits
and so at most 8,192 different fingerprints in any group.  No cap drops a link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ._common import PART, append_columns, fresh, slices, small_batches, stored, table, text_parts

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
SUB_BLOCKS = 8
#: Members of a key that one search takes directly.
GROUP = 4096

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(words: list[bytes], shingle: int, seed: int) -> list[int]:
    """The hash of each shingle of at least ``shingle`` words."""
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, stops)]


def bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in each run of hashes; no run is empty.

    Eight bit counters share a word; runs of 255 hashes cannot overflow one.
    """
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    runs = -(-counts // 255)
    run_first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    within = np.arange(runs.sum()) - np.repeat(run_first, runs)
    at = np.repeat(first, runs) + 255 * within
    out = np.empty((len(counts), 64), dtype=np.int64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, at)
        out[:, j::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0)
    return out


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED, part: int = PART) -> np.ndarray:
    """A uint64 per text: bit set if set in over half of the shingle hashes.

    A long text is hashed in parts of ``part`` characters, each with the last
    words of the one before; counts of bits are added up.
    """
    ones, total = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    hashes: list[int] = []
    owner, counts = [], []

    def flush():
        if hashes:
            n = np.array(counts)
            np.add.at(ones, owner, bit_counts(np.array(hashes, dtype=np.uint64), n))
            np.add.at(total, owner, n)
            for x in (hashes, owner, counts):
                x.clear()

    for i, text in enumerate(texts):
        carry: list[bytes] = []
        shingled = False
        for piece in text_parts(text, part):
            words = carry + piece.encode("utf-8", "surrogatepass").lower().split()
            if len(words) >= shingle:
                found = shingle_hashes(words, shingle, seed)
                hashes += found
                owner.append(i)
                counts.append(len(found))
                shingled = True
            carry = words[-(shingle - 1) :] if shingle > 1 else []
            if len(hashes) > part:
                flush()
        if carry and not shingled:  # fewer words than a shingle
            hashes.append(xxhash.xxh64_intdigest(b" ".join(carry), seed))
            owner.append(i)
            counts.append(1)
    flush()
    # Bit j of byte l is column 8 l + j.
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def with_fingerprint(docs: DataFrame, text: str, column: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` and the fingerprint as a (signed) long.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; fewer words than a
    shingle are one shingle; no words (null, empty) give zero.
    """
    small_batches(docs.sparkSession)
    index = docs.columns.index(text)

    def run(batches):
        for b in slices(batches, index):
            yield append_columns(b, **{column: pa.array(fingerprints(b.column(index).to_pylist(), shingle, seed).view(np.int64))})

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias(column)).schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal blocks of the given bits."""
    return [sum(1 << b for b in p.tolist()) for p in np.array_split(np.array(bits), parts)]


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    return [sum(c) for c in combinations(_cut(list(range(64)), blocks), blocks - distance)]


def sub_masks(mask: int, parts: int = SUB_BLOCKS, distance: int = DISTANCE) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(c) for c in combinations(_cut(free, parts), parts - distance)]


def stars(members: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(member, smallest member of its connected group) for linked uint64 members."""
    left = np.unique(members)
    out = []
    while len(left):
        seed, left = left[0], left[1:]
        front = np.array([seed], dtype=np.uint64)
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for i in range(0, len(front), 256):
                rest = np.flatnonzero(~near)
                x = front[i : i + 256, None] ^ left[None, rest]
                near[rest] |= (np.bitwise_count(x) <= distance).any(axis=0)
            front, left = left[near], left[~near]
            out += [(int(f), int(seed)) for f in front]
    return out


def _search(groups: DataFrame, distance: int) -> DataFrame:
    """Rows with ``members`` array<long> to star edges."""

    def run(batches):
        for b in batches:
            src, dst = [], []
            for m in b.column(0):
                for f, s in stars(np.array(m.as_py(), dtype=np.int64).view(np.uint64), distance):
                    src.append(_signed(f))
                    dst.append(_signed(s))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return groups.select("members").mapInArrow(run, "src long, dst long")


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """Distinct ``fp`` to edges (src, dst) that connect all pairs within ``distance``.

    The edges have the connected components of the full graph; they are not all
    of its pairs.
    """
    masks = block_masks(blocks, distance)
    keys = prints.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
        ).alias("key"),
    ).select("fp", "key.c", "key.k")
    shared = stored(
        keys.groupBy("c", "k").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"),
        "blocks",
        len(masks) * prints.count(),
    )
    pairs = shared.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= distance)).select(
        F.col("lo").alias("src"), F.col("hi").alias("dst")
    )
    many = keys.join(shared.where("n > 2").select("c", "k", "n"), ["c", "k"])
    direct = many.where(F.col("n") <= group).groupBy("c", "k").agg(F.collect_list("fp").alias("members"))
    finer = F.array(*[F.array(*[F.lit(_signed(x)) for x in sub_masks(m, distance=distance)]) for m in masks])
    cut = (
        many.where(F.col("n") > group)
        .select("fp", "c", F.posexplode(F.get(finer, F.col("c"))).alias("s", "mask"))
        .groupBy("c", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
    )
    return pairs.unionByName(_search(direct.select("members").unionByName(cut.select("members")), distance))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) per document.

    component_id is the smallest id reachable over links of at most ``distance``
    bits, the document's own included.  Null and empty texts share fingerprint
    zero.  Repeated rows stay, with equal results; null ids are ignored by the
    minimum (a component of null ids only has a null id).  An empty table gives
    an empty result.  Other columns are ignored; long texts are hashed in parts.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stored(with_fingerprint(own, "text", "fp", shingle).select("doc_id", "fp"), "prints")
    return _label(prints, distance)


def _label(prints: DataFrame, distance: int) -> DataFrame:
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes", prints.count())
    n = nodes.count()
    found = components(links(nodes.select("fp"), distance), n)
    linked = stored(nodes.join(found.withColumnRenamed("node", "fp"), "fp").select("fp", "label", "rep"), "linked", n)
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    classes = nodes.join(linked.join(least, "label").select("fp", "component_id"), "fp", "left").select(
        "fp", F.coalesce("component_id", "rep").alias("component_id")
    )
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Among rows that repeat that id and fingerprint the one with the smallest
    text stays (null first).  The columns are those of ``docs``.
    """
    fp, place, key = fresh("fp", docs), fresh("place", docs), fresh("key", docs)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stored(with_fingerprint(own, "text", "fp", shingle).select("doc_id", "fp"), "prints")
    groups = _label(prints, distance)

    def joined(i, f):
        return F.concat_ws(" ", F.coalesce(i.cast("string"), F.lit("\x00")), f.cast("string"))

    # min(struct) is combined on the map side, so a large group stays spread out.
    keep = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "fp")).alias("w"))
    keep = keep.select(joined(F.col("w.doc_id"), F.col("w.fp")).alias(key))
    # Texts move once: fingerprints are made again rather than kept with them,
    # and the join and the choice among repeated rows share one key.
    marked = with_fingerprint(docs, text, fp, shingle).withColumn(key, joined(F.col(doc_id), F.col(fp)))
    return (
        marked.join(keep, key, "left_semi")
        .withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.col(text).asc_nulls_first())))
        .where(F.col(place) == 1)
        .select(*docs.columns)
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows stay; an empty table gives no rows; long texts are hashed in
    parts.
    """
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
