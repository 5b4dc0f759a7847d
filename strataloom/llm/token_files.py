"""Token files with directly addressable codes.

An id is split into chunks of ``WIDTH`` bits, lowest first.  Level k holds the
k-th chunk of every id that has one, a bitmap that says which ids go on, and a
rank directory (set bits before every block of 512), so the place of an id's
next chunk is one rank away (Brisaboa, Ladra and Navarro, "DACs: Bringing direct
access to variable-length codes", 2013).  Any id is read in as many steps as it
has chunks, and nothing before it is decoded.

A token file is a Parquet folder, so that Spark's committer handles lost
executors and any store will do.  Each row is one segment: its number, the
documents it holds, and a self-contained code of their ids.  A second small
folder, ``parts``, has the global number of the first id of each part.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_path, slices, small_batches, table
from ._tokens import encoder, public_path

WIDTH = 8
BLOCK = 512
MAGIC = b"DAC1"
#: Documents in a segment at most.
SEGMENT_ROWS = 1024


class Code:
    """A sequence of unsigned integers, addressable one by one."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int):
        self.levels, self.n = levels, n

    @classmethod
    def of(cls, values: np.ndarray) -> Code:
        v, levels = values.astype(np.uint64), []
        while len(v):
            chunk = (v & np.uint64((1 << WIDTH) - 1)).astype(np.uint8)
            v = v >> np.uint64(WIDTH)
            more = v > 0
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), dtype=np.uint8)))
            ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            levels.append((chunk, bits, np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4")))
            v = v[more]
        return cls(levels, len(values))

    def take(self, at: np.ndarray) -> np.ndarray:
        """The values at these places (0-based), each by its own chain of ranks."""
        at = np.asarray(at, dtype=np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such id")
        out = np.zeros(len(at), dtype=np.uint64)
        live = np.arange(len(at))
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            out[live] |= chunk[at].astype(np.uint64) << np.uint64(WIDTH * k)
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, at = live[on], at[on]
            if not len(at):
                break
            # Set bits before a place: the directory, whole bytes, the byte's low bits.
            byte = at >> 3
            block = at // BLOCK
            base = block * (BLOCK // 8)
            if len(at) > len(bits) // 8:  # many places: count bytes once for all
                before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
                inner = before[byte] - before[base]
            else:
                window = base[:, None] + np.arange(BLOCK // 8)
                inner = (np.bitwise_count(bits[window]) * (window < byte[:, None])).sum(axis=1, dtype=np.int64)
            low = np.bitwise_count(bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8))
            at = ranks[block].astype(np.int64) + inner + low
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        return self.take(np.arange(start, stop))

    def all(self) -> np.ndarray:
        """Every value in order; level after level needs no ranks."""
        out, live = np.zeros(self.n, dtype=np.uint64), None
        for k, (chunk, bits, _) in enumerate(self.levels):
            part = chunk.astype(np.uint64) << np.uint64(WIDTH * k)
            on = np.unpackbits(bits, count=len(chunk), bitorder="little").view(bool)
            if live is None:
                out, live = part, np.flatnonzero(on)
            else:
                out[live] |= part
                live = live[on]
        return out

    def to_bytes(self) -> bytes:
        head = [MAGIC, np.array([self.n, len(self.levels), *[len(c) for c, _, _ in self.levels]], dtype="<u8").tobytes()]
        return b"".join(head + [a.tobytes() for level in self.levels for a in level])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Code:
        if raw[:4] != MAGIC:
            raise ValueError("not a code of this format")
        n, k = np.frombuffer(raw, "<u8", 2, 4).tolist()
        sizes = np.frombuffer(raw, "<u8", k, 20).tolist()
        at, levels = 20 + 8 * k, []
        for size in sizes:
            blocks = -(-size // BLOCK)
            level = []
            for kind, m in (("u1", size), ("u1", blocks * BLOCK // 8), ("<u4", blocks)):
                level.append(np.frombuffer(raw, kind, m, at))
                at += level[-1].nbytes
            levels.append(tuple(level))
        return cls(levels, n)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", special_as_text: bool = False) -> None:
    """Write the ids of all documents, in ascending order of doc_id, under ``path``.

    A document is the ids of its text and ``end_id``; null and empty texts are
    the end id alone.  Null ids come first; documents with one id are ordered by
    text.  Repeated rows are written as often as they occur.  No rows give empty
    folders.  Other columns are ignored.  A segment holds documents of about
    ``SLICE_BYTES`` of text, or one longer document, so its code is bounded by
    that.  Strings of the tokenizer's added tokens become those tokens, as the
    library has it, or ordinary text with ``special_as_text``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    # The hash lets a repeated id spread over several ranges.
    ordered = own.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie.asc()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), tie.asc(), F.col("text").asc_nulls_first()
    )
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"part int, segment int, part_start bigint, n_tokens bigint, doc_ids array<{kind}>, lengths array<bigint>, code binary"

    def run(batches):
        enc = encoder(tokenizer, special_as_text)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        done = 0
        for segment, b in enumerate(slices(batches, 1, rows=SEGMENT_ROWS)):
            flat, counts = enc.encode_flat(b.column(1).to_pylist())
            ids = np.full(len(flat) + len(counts), end_id, dtype=enc.dtype)
            ids[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
            row = {
                "part": [part], "segment": [segment], "part_start": [done], "n_tokens": [len(ids)], "doc_ids": [b.column(0).to_pylist()],
                "lengths": [counts + 1], "code": [Code.of(ids).to_bytes()],
            }
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(b.schema.field(0).type), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds)], names=list(row))
            done += len(ids)

    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{path}/segments")
    # One number per task that wrote: as many as there are parts, not documents.
    totals = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    first, rows = 0, []
    for r in sorted(totals):
        rows.append((r.part, first, r.n))
        first += r.n
    spark.createDataFrame(rows, "part int, first_token bigint, n_tokens bigint").coalesce(1).write.parquet(f"{path}/parts")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(f"{path}/parts").select("part", "first_token")
    segments = spark.read.parquet(f"{path}/segments")
    return segments.join(F.broadcast(parts), "part").withColumn("start", F.col("first_token") + F.col("part_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document read back from the files."""
    segments = _segments(spark, path).select("start", "doc_ids", "lengths", "code")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for start, doc_ids, lengths, raw in zip(*(b.column(i) for i in range(4))):
                code, n = Code.from_bytes(raw.as_py()), np.array(lengths.as_py(), dtype=np.int64)
                first = np.concatenate(([0], np.cumsum(n)[:-1]))
                values = code.all().astype("<u4")
                ids = [values[a : a + m].tobytes() for a, m in zip(first.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.as_py(), b.schema.field(1).type.value_type), pa.array(first + start.as_py()), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> dict[int, int]:
    """The ids at these global places; only the segments that hold them are decoded.

    One job for all places: ``parts`` says which parts hold them, and
    the part is compared with a stored column, so other parts' files are skipped;
    only the codes of segments that are hit are sent.
    """
    wanted = sorted(set(places))
    parts = sorted(tuple(r) for r in spark.read.parquet(f"{path}/parts").collect())
    hit, at = [], 0
    for part, first, n in parts:
        while at < len(wanted) and wanted[at] < first + n:
            if wanted[at] < first:
                break
            hit.append((part, wanted[at] - first, wanted[at]))
            at += 1
    if at < len(wanted):
        raise IndexError(wanted[at])
    if not hit:
        return {}
    segments = spark.read.parquet(f"{path}/segments").where(F.col("part").isin(sorted({p for p, _, _ in hit})))
    asked = F.broadcast(spark.createDataFrame(hit, "part int, place bigint, at bigint"))
    # As many rows as places were asked for.
    inside = (F.col("place") >= F.col("part_start")) & (F.col("place") < F.col("part_start") + F.col("n_tokens"))
    found = segments.join(asked, "part").where(inside).groupBy("part", "segment").agg(F.first("code").alias("code"), F.collect_list(F.struct("at", F.col("place") - F.col("part_start"))).alias("asked"))

    def run(batches):
        for b in batches:
            for raw, these in zip(b.column(2), b.column(3).to_pylist()):
                at, place = zip(*(x.values() for x in these))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(Code.from_bytes(raw.as_py()).take(np.array(place)).astype(np.int64))], names=["at", "id"])

    return {r.at: r.id for r in found.mapInArrow(run, "at bigint, id bigint").collect()}


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as token files and read back.

    Null and empty texts are the end id alone; repeated rows are separate
    documents; ids are in the order of doc_id, ties by text; an empty table gives
    no rows; long texts are encoded in parts.
    """
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"))
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
