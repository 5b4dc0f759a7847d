"""Sequence packing as vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.
Each task fills one sequence after another: of the pieces in a bounded pool it
takes the one that fits and whose demand has the largest dot product with what
the sequence has left (both as shares of the limits), until none fits; then one
piece is cut to fill the tokens that are left (Panigrahy et al., "Heuristics for
Vector Bin Packing", 2011).  Documents never leave the task that read them, so
packing needs no shuffle, and a task leaves at most a few sequences unfilled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, small_batches, table
from ._tokens import CACHE, encoder, public_path

PIECES = "doc_id {id}, start bigint, ids binary, length bigint, loss_tokens bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@dataclass
class Limits:
    """Limits of a sequence. ``pool`` bounds the pieces that wait in a task."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    pool: int = 2048
    #: Shortest piece that a cut may leave behind or put in front.
    least: int = 4


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    total: int
    #: 1 for a token that bears loss. The first token of a piece never does: it
    #: has nothing before it to be predicted from.
    loss: np.ndarray | None = None

    def demand(self) -> tuple[int, int]:
        return len(self.ids), (len(self.ids) - 1 if self.loss is None else int(self.loss[1:].sum()))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        loss = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.doc, self.start, self.ids[:n], self.total, loss[0]), Piece(self.doc, self.start + n, self.ids[n:], self.total, loss[1])


@dataclass
class Packer:
    limits: Limits
    waiting: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece):
        """Yield sequences (lists of pieces) that become full."""
        room = self.limits.tokens
        while len(piece.ids) > room:
            part, rest = piece.cut(room)
            if part.demand()[1] > self.limits.loss:
                part, rest = piece.cut(self._loss_cut(part))
                self.waiting.append(part)
            else:
                yield [part]
            piece = rest
        while piece.demand()[1] > self.limits.loss:
            part, piece = piece.cut(self._loss_cut(piece))
            self.waiting.append(part)
        self.waiting.append(piece)
        if len(self.waiting) >= 2 * self.limits.pool:
            yield from self.pack(self.limits.pool)

    def _loss_cut(self, piece: Piece) -> int:
        if piece.loss is None:
            return self.limits.loss + 1
        return max(1, int(np.searchsorted(np.cumsum(piece.loss[1:]), self.limits.loss, side="right")) + 1)

    def pack(self, keep: int = 0):
        """Fill sequences until at most ``keep`` pieces wait."""
        lim = self.limits
        pieces = self.waiting
        t = np.array([p.demand()[0] for p in pieces], dtype=np.float64)
        x = np.array([p.demand()[1] for p in pieces], dtype=np.float64)
        live = np.arange(len(pieces))
        while len(live) > keep:
            room, slots, loss = lim.tokens, lim.segments, lim.loss
            chosen: list[Piece] = []
            taken = np.zeros(len(pieces), dtype=bool)
            while slots and room:
                fits = live[(t[live] <= room) & (x[live] <= loss) & ~taken[live]]
                if not len(fits):
                    break
                # Shares of the limits, demand times what is left; each piece is one segment.
                score = t[fits] * (room / lim.tokens**2) + x[fits] * (loss / lim.loss**2) + slots / lim.segments**2
                i = fits[int(score.argmax())]
                chosen.append(pieces[i])
                taken[i] = True
                room, slots, loss = room - int(t[i]), slots - 1, loss - int(x[i])
            live = live[~taken[live]]
            if slots and room >= lim.least and len(live):
                # None fits whole: cut one whose two parts are both worth keeping.
                long = live[t[live] >= room + lim.least]
                for i in long[np.argsort(-t[long], kind="stable")]:
                    front, rest = pieces[i].cut(room)
                    if front.demand()[1] <= loss:
                        chosen.append(front)
                        pieces[i] = rest
                        t[i], x[i] = rest.demand()
                        break
            if chosen:
                yield chosen
        self.waiting = [pieces[i] for i in live]


def segments(text: str | None, spans: list) -> tuple[list[str], list[bool]]:
    """The text cut where loss begins or ends, and whether each part bears loss.

    Spans are (begin, end) in characters; they may touch or overlap.
    """
    text = text or ""
    parts, loss, at = [], [], 0
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        begin, end = max(begin, at), min(end, len(text))
        if begin >= end:
            continue
        if begin > at:
            parts.append(text[at:begin])
            loss.append(False)
        if loss and loss[-1]:
            parts[-1] += text[begin:end]
        else:
            parts.append(text[begin:end])
            loss.append(True)
        at = end
    if at < len(text):
        parts.append(text[at:])
        loss.append(False)
    return parts, loss


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", limits: Limits | None = None, loss_spans: str | None = None, special_as_text: bool = False, cache: int = CACHE,
) -> DataFrame:
    """Pieces of tokenised documents, placed in sequences.

    A document is the ids of its text and ``end_id``; a null or empty text is
    the end id alone.  Columns: doc_id, start (ids of the document before the
    piece), ids (binary, little-endian unsigned 32 bits), length, loss_tokens,
    doc_tokens, sequence_id, offset (place in the sequence).  Each id of a
    document lies in exactly one piece.  Repeated rows are packed as often as
    they occur; ids may be null; no rows give no pieces; other columns are
    ignored.  Sequence numbers are unique, not consecutive (the upper bits are
    the task's number).

    ``loss_spans`` is a column of array<struct<begin, end>>: the characters that
    bear loss.  Such a text is encoded part by part, cut where loss begins or
    ends; the end id bears loss if the last part does.  A null array, like no
    column, means that every token bears loss.  A worker remembers the ids of up to
    twice ``cache`` pieces of text (about 200 bytes each), also after its task.
    """
    small_batches(docs.sparkSession)
    limits = limits or Limits()
    spans = [F.transform(loss_spans, lambda s: F.struct(s["begin"].cast("long").alias("begin"), s["end"].cast("long").alias("end"))).alias("spans")] if loss_spans else []
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *spans)
    masked = bool(spans)
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer, special_as_text, cache)
        packer = Packer(limits)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        end = np.array([end_id], dtype=enc.dtype)
        doc_type = None

        def rows(sequences):
            nonlocal number
            cols: list[list] = [[] for _ in range(8)]
            for seq in sequences:
                at = 0
                for p in seq:
                    n, loss = p.demand()
                    for c, v in zip(cols, (p.doc, p.start, p.ids.astype("<u4").tobytes(), n, loss, p.total, number, at)):
                        c.append(v)
                    at += n
                number += 1
                if len(cols[0]) >= 2048:
                    yield batch(cols)
                    cols = [[] for _ in range(8)]
            if cols[0]:
                yield batch(cols)

        def batch(cols):
            types = [doc_type, pa.int64(), pa.binary(), *[pa.int64()] * 5]
            names = ["doc_id", "start", "ids", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in slices(batches, 1):
            doc_type = b.schema.field(0).type
            full = []
            texts = b.column(1).to_pylist()
            cut = [s if s is None else segments(x, s) for x, s in zip(texts, b.column(2).to_pylist())] if masked else [None] * len(texts)
            found = iter(enc.encode([part for x, c in zip(texts, cut) for part in ([x] if c is None else c[0])]))
            for doc, c in zip(b.column(0).to_pylist(), cut):
                parts = [next(found) for _ in range(1 if c is None else len(c[0]))]
                ids = np.concatenate((*parts, end))
                loss = None if c is None else np.repeat([*c[1], bool(c[1] and c[1][-1])], [*map(len, parts), 1])
                full += packer.add(Piece(doc, 0, ids, len(ids), loss))
            yield from rows(full)
        if doc_type is not None:
            yield from rows(packer.pack())

    return own.mapInArrow(run, PIECES.format(id=kind))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids.

    A null or empty text is its end id alone; null ids and repeated rows are
    packed like others; an empty table gives no rows; other columns are ignored;
    long texts are encoded in parts and cut into several pieces.
    """
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame, cache: int = CACHE) -> DataFrame:
    """The digest columns of the packing of ``docs``; see ``pack`` for nulls, repeats and empty tables.

    Plain documents bear loss on every id but a piece's first, so the limit of
    loss, which is that of the tokens, never binds here.
    """
    return pack(docs, public_path("word_bpe_49k.json"), 1, cache=cache).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )
