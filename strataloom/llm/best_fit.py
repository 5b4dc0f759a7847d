"""Best-fit packing in bulk-synchronous rounds.

Documents come in classes of falling size, each at most half as large as the one
before.  A round sorts the unplaced documents of a class by size and the open
gaps by room into one range order; a gap that surely holds several documents
offers as many places.  A sweep reads a range upwards and gives each place the
largest document below it that no smaller one has taken, which is each
document's smallest free place (its successor).  Documents and places that a
range leaves over are numbered, and the numbers of the ranges, two per range,
tell which meet across ranges.  Then rooms shrink, and the class goes on until
all its documents lie somewhere.  A round opens as many sequences as the
documents need that will find no place.  What it decides is stored in the shared
folder, so a lost executor costs a part of one round.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import slices, small_batches, stored, table
from ._tokens import encoder, public_path

CAPACITY = 2048
#: Documents and places of a range.
RANGE_ROWS = 200_000
#: Classes of documents: all below the last halving are one.
CLASSES = 6
#: Bytes of ids in a batch that a task passes on.
BATCH = 4 << 20

STATE = "item bigint, size bigint, bin bigint, slot bigint, part int, place bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str, text: str, capacity: int, special_as_text: bool) -> DataFrame:
    """(item, doc_id, piece, start, length, ids, ids_crc32): documents as ids, cut where they are longer than a sequence."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["item", "doc_id", "piece", "start", "length", "ids", "ids_crc32"]

    def run(batches):
        enc = encoder(tokenizer, special_as_text)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        end = np.array([end_id], dtype=enc.dtype)
        for b in slices(batches, 1):
            rows: list[tuple] = []
            held = 0
            types = [pa.int64(), b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

            def batch():
                cols = zip(*rows)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                ids = np.concatenate((ids, end))
                at = 0
                for k in range(-(-len(ids) // capacity)):
                    stop = at + capacity if k else (len(ids) - 1) % capacity + 1  # the first piece has what is over
                    part = ids[at:stop]
                    rows.append((number, doc, k, at, len(part), part.tobytes(), zlib.crc32(part.astype("<u4").tobytes())))
                    number, at, held = number + 1, stop, held + part.nbytes
                    if held > BATCH:
                        yield batch()
                        rows, held = [], 0
            if rows:
                yield batch()

    return own.mapInArrow(run, f"item bigint, doc_id {kind}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint")


def sweep(rows, part: int):
    """Match sorted (value, is place, number, slot) rows; a place takes the nearest free document below it.

    Yields (item, size, bin, slot, part, place): pairs, and what is left over
    with its number among the documents or places that are left of this part.
    """
    free: list[tuple[int, int]] = []
    closed = 0
    for value, gap, number, slot in rows:
        if not gap:
            free.append((number, value))
        elif free:
            item, size = free.pop()
            yield item, size, number, slot, None, None
        else:
            yield None, None, number, slot, part, closed
            closed += 1
    for place, (item, size) in enumerate(free):
        yield item, size, None, None, part, place


def left_over(sizes: dict[int, int], places: dict[int, int]) -> dict[int, int]:
    """The sizes of the documents that a round leaves without a place: the sweep on numbers per value."""
    free: list[list[int]] = []
    for value in sorted({*sizes, *places}):
        if value in sizes:
            free.append([value, sizes[value]])
        n = places.get(value, 0)
        while n and free:
            k = min(n, free[-1][1])
            n, free[-1][1] = n - k, free[-1][1] - k
            if not free[-1][1]:
                free.pop()
    return dict(free)


def offered(rooms: dict[int, int], largest: int, most: int) -> dict[int, int]:
    """Places by value of gaps by room: as many as surely hold documents of ``largest``, at most ``most`` a gap."""
    out: dict[int, int] = {}
    for room, n in rooms.items():
        k = max(1, min(room // largest, most))
        for value, m in ((largest, (k - 1) * n), (room - (k - 1) * largest, n)):
            if m:
                out[value] = out.get(value, 0) + m
    return out


def across(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """How leftovers of parts meet: ``left`` has the numbers of documents and of gaps by part.

    Returns (part of the gaps, first gap, part of the documents, documents from
    the largest down to here, number): the same matching, on whole runs.
    """
    free: list[list[int]] = []
    out = []
    for part in sorted(left):
        docs, gaps = left[part]
        at = 0
        while at < gaps and free:
            n = min(gaps - at, free[-1][1])
            free[-1][1] -= n
            out.append((part, at, free[-1][0], free[-1][1], n))
            at += n
            if not free[-1][1]:
                free.pop()
        if docs:
            free.append([part, docs])
    return out


def _slots(gaps: DataFrame, largest: int, most: int) -> DataFrame:
    """(value, gap, number, slot): the places of (bin, room) as ``offered`` counts them."""
    k = F.greatest(F.lit(1).cast("long"), F.least(F.floor(F.col("room") / largest), F.lit(most).cast("long")))
    each = gaps.select("bin", "room", k.alias("k")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("slot"))
    value = F.when(F.col("slot") < F.col("k") - 1, F.lit(largest)).otherwise(F.col("room") - (F.col("k") - 1) * largest)
    return each.select(value.cast("long").alias("value"), F.lit(1).alias("gap"), F.col("bin").alias("number"), "slot")


def _round(docs: DataFrame, slots: DataFrame, rows: int) -> DataFrame:
    """(item, size, bin, slot) after one round; bin and slot are null for documents without a place."""
    spark = docs.sparkSession
    both = docs.select(F.col("size").alias("value"), F.lit(0).alias("gap"), F.col("item").alias("number"), F.lit(0).cast("long").alias("slot")).unionByName(slots)
    order = ["value", "gap", "number", "slot"]
    ranged = both.repartitionByRange(max(1, -(-rows // RANGE_ROWS)), *order).sortWithinPartitions(*order)
    types = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
    names = ["item", "size", "bin", "slot", "part", "place"]

    def run(batches):
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for r in sweep(rows, part):
            out.append(r)
            if len(out) == 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    swept = stored(ranged.mapInArrow(run, STATE), "best-fit-sweep")
    found = swept.where("item is not null").select("item", "size", "bin", "slot")
    if rows <= RANGE_ROWS:  # one range leaves nothing that could meet
        return found
    # Two numbers a range.
    left = {r.part: (r.docs, r.gaps) for r in swept.where("part is not null").groupBy("part").agg(F.count("item").alias("docs"), F.count("bin").alias("gaps")).collect()}
    meet = across(left)
    if not meet:
        return found
    base = np.cumsum([0] + [m[4] for m in meet]).tolist()
    gap_runs = spark.createDataFrame([(g, a, a + n, b - a) for (g, a, _, _, n), b in zip(meet, base)], "of int, first bigint, stop bigint, shift bigint")
    doc_runs = spark.createDataFrame([(d, a, a + n, b + a + n - 1) for (_, _, d, a, n), b in zip(meet, base)], "of int, first bigint, stop bigint, shift bigint")
    inside = (F.col("part") == F.col("of")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("stop"))
    # At most two runs a range: broadcast whatever the number of documents.
    alone = swept.where("part is not null")
    free = alone.where("item is not null").join(F.broadcast(doc_runs), inside, "left").select("item", "size", (F.col("shift") - F.col("place")).alias("pair"))
    open_ = alone.where("bin is not null").join(F.broadcast(gap_runs), inside).select("bin", "slot", (F.col("shift") + F.col("place")).alias("pair"))
    pairs = free.join(open_, "pair", "left").select("item", "size", "bin", "slot")
    return stored(swept.where("part is null").select("item", "size", "bin", "slot").unionByName(pairs), "best-fit-round")


def _counts(df: DataFrame, value: str) -> dict[int, int]:
    """How many rows have each size or room: at most a number a token of capacity, whatever the rows."""
    return {r[0]: r[1] for r in df.groupBy(value).count().collect()}


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, sequence_id, offset): items of (item, size) placed in sequences of at most ``capacity``.

    ``item`` is a distinct number, ``size`` is from 1 to ``capacity``.  Offsets of
    a sequence are gapless from 0.  No items give no rows; equal sizes are told
    apart by number.
    """
    spark = items.sparkSession
    items = items.select("item", F.col("size").cast("long").alias("size"))
    all_sizes = _counts(items, "size")
    gaps, rooms, next_bin, placed = None, {}, 0, None
    bounds = [capacity >> i for i in range(CLASSES)] + [0]
    for upper, lower in zip(bounds, bounds[1:]):
        sizes = {s: n for s, n in all_sizes.items() if lower < s <= upper}
        docs = items.where((F.col("size") > lower) & (F.col("size") <= upper))
        while sizes:
            largest, least = max(sizes), min(sizes)
            fit = {r: n for r, n in rooms.items() if r >= least}
            # Gaps offer no more places than documents are there to take them.
            most = -(-sum(sizes.values()) // max(1, sum(fit.values())))
            places = offered(fit, largest, most)
            left = left_over(sizes, places)
            new = max(-(-sum(s * n for s, n in left.items()) // capacity), sum(n for s, n in left.items() if 2 * s > capacity))
            fresh = spark.range(next_bin, next_bin + new).select(F.col("id").alias("bin"), F.lit(capacity).cast("long").alias("room"))
            next_bin += new
            slots = _slots(fresh, largest, capacity)
            for value, n in offered({capacity: new} if new else {}, largest, capacity).items():
                places[value] = places.get(value, 0) + n
            if gaps is not None:
                slots = _slots(gaps.where(F.col("room") >= least), largest, most).unionByName(slots)
            state = _round(docs, slots, sum(sizes.values()) + sum(places.values()))
            pairs = state.where("bin is not null").withColumn("turn", F.lit(len(placed) if placed else 0))
            placed = [*(placed or []), pairs]
            taken = pairs.groupBy("bin").agg(F.sum("size").alias("taken"))
            before = fresh if gaps is None else gaps.unionByName(fresh)
            gaps = stored(before.join(taken, "bin", "left").select("bin", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room")).where("room > 0"), "best-fit-gaps")
            rooms = _counts(gaps, "room")
            docs, sizes = state.where("bin is null").select("item", "size"), left_over(sizes, places)
    if not placed:
        return items.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    # A sequence has at most ``capacity`` items.
    w = Window.partitionBy("bin").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    return out.select("item", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long").alias("offset"))


def pack_best_fit(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, special_as_text: bool = False) -> DataFrame:
    """Pieces of tokenised documents, placed in as few sequences as best fit finds.

    A document is the ids of its text and ``end_id``; a null or empty text is the
    end id alone.  Only documents longer than ``capacity`` are cut, into pieces
    of ``capacity`` ids but for the first, which has what is over; long texts
    are encoded in parts.  Columns: doc_id, piece, start, length, ids (binary,
    little-endian unsigned, 2 bytes an id if the vocabulary allows it, else 4),
    ids_crc32 (of the ids in 4 bytes each), sequence_id (not consecutive), offset.
    Repeated rows are packed as often as they occur, ids may be null, no rows
    give no pieces, other columns are ignored, and ties go by reading order.
    """
    all_ = stored(pieces(docs, tokenizer, end_id, doc_id, text, capacity, special_as_text), "best-fit-pieces")
    places = best_fit(all_.where(F.col("length") < capacity).select("item", F.col("length").alias("size")), capacity)
    columns = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]
    full = all_.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")})
    return full.select(columns).unionByName(all_.where(F.col("length") < capacity).join(places, "item").select(columns))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids, by best fit; see ``pack_best_fit`` for nulls, ties and repeats."""
    out = pack_best_fit(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), 0)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
