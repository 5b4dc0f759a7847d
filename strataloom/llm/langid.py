"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, runs of other characters become one space, and n-grams of
1 to 4 characters (word borders included) are hashed into ``BUCKETS`` counters.
Counting is distributed; the log-probability matrix (classes x buckets, a fixed
size) is broadcast, and batches of texts are scored by gathering its rows and
summing them per text in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import PART, append_columns, fresh, remainder, slices, small_batches, table, text_parts, without

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: Bytes of the broadcast table: 2,048 labels.
TABLE_BYTES = 512 << 20
#: Training rows per class at most (in expectation): a hash of the id selects them.
ROWS_PER_CLASS = 5_000
#: Labels counted in one pass: a task's counts take 512 KB a label.
CLASSES = 64
#: Bytes of the table's rows that are gathered at a time.
GATHER = 32 << 20
#: Characters that are worked on at a time (about 60 bytes of arrays each).
GROUP = 1 << 19
#: n-grams that a text's evidence counts for at most, so that scores of long
#: texts stay comparable.
EVIDENCE = 50.0
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Letters of the basic plane."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)
    return _letters


def grams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams of a batch.

    Returns one array of bucket numbers per order, the first gram of each text
    (the same for all orders: a gram starts at every character of the padded
    text), and whether each text has a letter.
    """
    low = [(t or "").lower() for t in texts]
    # Spaces end a text; grams that start in the last of them are set to bucket 0.
    raw = np.frombuffer("".join([f" {t}    " for t in low]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter((len(t) + 5 for t in low), dtype=np.int64, count=len(low))
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    letter = _letter_table()[np.minimum(raw, 0xFFFF)]
    if (astral := np.flatnonzero(raw > 0xFFFF)).size:
        known, back = np.unique(raw[astral], return_inverse=True)
        letter[astral] = np.array([chr(c).isalpha() for c in known.tolist()])[back]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after a run of letters
    keep[first] = True
    ends = np.zeros(len(raw), dtype=bool)
    for j in range(1, 4):
        ends[first + lengths - j] = True
    keep |= ends
    chars = np.where(letter, raw, 32).astype(np.uint32)[keep]
    starts = np.concatenate(([0], np.cumsum(np.add.reduceat(keep, first, dtype=np.int64))[:-1])) if len(low) else np.empty(0, np.int64)
    stops = np.append(starts[1:], len(chars)) if len(low) else starts
    has = np.logical_or.reduceat(letter, first) if len(low) else np.empty(0, bool)
    out, h = [], np.zeros(len(chars), dtype=np.uint32)
    padded = np.concatenate((chars, np.full(max(ORDERS), 32, dtype=np.uint32)))
    for n in range(1, max(ORDERS) + 1):
        h = (h ^ padded[n - 1 : n - 1 + len(chars)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            grams_n = (h & np.uint32(BUCKETS - 1)).astype(np.int32)
            for j in range(1, n):  # these would reach into the next text
                grams_n[stops - j] = 0
            out.append(grams_n)
    return out, starts, has


def pieces_of(texts: list[str | None], part: int = PART, group: int = GROUP):
    """(pieces, numbers of their texts) of about ``group`` characters at a time.

    Texts longer than ``part`` are cut before white space; the n-grams of the
    parts are those of the text but for a border at each cut.
    """
    pieces, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in text_parts(text, part):
            if pieces and size + len(piece) > group:
                yield pieces, owner
                pieces, owner, size = [], [], 0
            pieces.append(piece)
            owner.append(i)
            size += len(piece)
    if pieces:
        yield pieces, owner


class Model:
    """Classes and their log probabilities, (buckets, classes) float32."""

    def __init__(self, classes: list[str], counts: np.ndarray):
        self.classes = classes
        smooth = counts + SMOOTHING
        self.table = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The best class and its posterior for each text; "und" and 0 without a letter."""
        total, n = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        has = np.zeros(len(texts), dtype=bool)
        step = max(1, GATHER // (4 * len(self.classes)))
        for pieces, owner in pieces_of(texts):
            orders, first, letters = grams(pieces)
            sums = np.zeros((len(pieces), len(self.classes)))
            for g in orders:
                for i in range(0, len(g), step):  # bounded temporary
                    part = self.table[g[i : i + step]]
                    at = np.searchsorted(first, i, side="right") - 1
                    stop = np.searchsorted(first, i + len(part), side="left")
                    cuts = np.maximum(first[at:stop] - i, 0)
                    sums[at:stop] += np.add.reduceat(part, cuts, axis=0, dtype=np.float64)
            np.add.at(total, owner, sums)
            np.add.at(n, owner, np.diff(np.concatenate((first, [len(orders[0])]))) * len(orders))
            np.logical_or.at(has, owner, letters)
        if not len(texts):
            return [], np.empty(0)
        z = total * (np.minimum(n, EVIDENCE) / n)[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names = [self.classes[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
        return names, np.where(has, p[np.arange(len(best)), best], 0.0)


def train(labelled: DataFrame, label: str = "lang", text: str = "text", doc_id: str = "doc_id", rows_per_class: int = ROWS_PER_CLASS, classes: int = CLASSES) -> Model | None:
    """Count n-grams of a bounded sample of labelled rows.

    Rows with a null label or text are not used.  A class with more than
    ``rows_per_class`` rows is thinned by a hash of the id to about that many;
    each class then weighs the same.  Every label is a class; they are counted
    ``classes`` at a time, so a task's counts are bounded.  The table takes
    256 KB a class and is broadcast, so more labels than ``TABLE_BYTES`` has room
    for are an error, and none is dropped.  Repeated rows count as often as they occur; empty texts add
    nothing but a border; a null id is drawn like any other.  None if no row is
    left, as with an empty table.
    """
    small_batches(labelled.sparkSession)
    own = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id")
    )
    sizes = sorted(own.groupBy("label").count().limit(TABLE_BYTES // (4 * BUCKETS) + 1).collect())
    if not sizes:
        return None
    if len(sizes) * 4 * BUCKETS > TABLE_BYTES:
        raise ValueError(f"the table of more than {len(sizes) - 1} labels is larger than {TABLE_BYTES} bytes")
    blocks = [_count(own, sizes[i : i + classes], rows_per_class) for i in range(0, len(sizes), classes)]
    return Model([name for names, _ in blocks for name in names], np.concatenate([counts for _, counts in blocks], axis=1) if len(blocks) > 1 else blocks[0][1])


def _count(own: DataFrame, sizes: list, rows_per_class: int) -> tuple[list[str], np.ndarray]:
    """Labels and their n-gram counts, (buckets, labels)."""
    names = sorted(r.label for r in sizes)
    number = {name: i for i, name in enumerate(names)}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.label, min(1.0, rows_per_class / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = own.where(draw < F.element_at(share, F.col("label"))).select("label", "text")

    def count(batches):
        sums = np.zeros((len(names), BUCKETS), dtype=np.int64)
        for b in slices(batches, 1):
            labels = np.array([number[x] for x in b.column(0).to_pylist()])
            for pieces, owner in pieces_of(b.column(1).to_pylist()):
                orders, first, _ = grams(pieces)
                whose = np.repeat(labels[owner], np.diff(np.concatenate((first, [len(orders[0])]))))
                for g in orders:
                    sums += np.bincount(whose * BUCKETS + g, minlength=len(names) * BUCKETS).reshape(sums.shape)
        which, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which * BUCKETS + bucket), pa.array(sums[which, bucket])], names=["cell", "n"])

    total = np.zeros(len(names) * BUCKETS)
    cells = sample.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return names, total.reshape(len(names), BUCKETS).T


def predict(docs: DataFrame, model: Model | None, lang: str, score: str, text: str = "text") -> DataFrame:
    """``docs`` with the predicted label and its score (0 to 1) as two more columns.

    Null texts and texts without a letter are "und" with score 0, and so is all
    without a model.  Ties go to the alphabetically first label.  Rows, repeated
    ones too, and other columns stay as they are, but columns named ``lang`` or
    ``score`` are replaced; no rows give no rows.  Long texts are scored in parts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, [lang, score], [text])
    shipped = spark.sparkContext.broadcast((model.classes, model.table) if model else None)
    index = docs.columns.index(text)

    def run(batches):
        m = Model.__new__(Model)
        if shipped.value:
            m.classes, m.table = shipped.value
        for b in slices(batches, index):
            texts = b.column(index).to_pylist()
            names, scores = m.predict(texts) if shipped.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield append_columns(b, **{lang: pa.array(names, pa.string()), score: pa.array(scores, pa.float64())})

    schema = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least: float = 0.5, label: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose language is found with at least this score.

    The model learns from the labels of ``docs`` itself.  Without any label
    nothing can be told, and nothing is rejected but texts without a letter
    (null and empty ones too).  A null label or id does not matter for a row's
    own fate; repeated rows share theirs; no rows give no rows.
    """
    model = train(docs, label, text, doc_id)
    lang, score = fresh("lang_pred", docs), fresh("lang_score", docs)
    if model is None:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return predict(docs, model, lang, score, text).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the labels that are not held out.

    Null and empty texts, and texts without a letter, are "und" with score 0; a
    null id is not held out; repeated rows stay; an empty table gives no rows;
    whole texts are scored, long ones in parts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), model, "lang_pred", "score").select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )
