"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; unlabelled texts are drawn from all
texts, and none counts as negative.  With the class prior pi, the risk of a scorer g under the logistic
loss l is

    pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])

(Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator",
2017).  Where the second term falls below zero, a step goes against its gradient
instead.  Features are words and word beginnings, so that unseen endings of a
known stem count; the few thousand that are most over-represented among
positives are kept, which makes ordinary words weigh nothing.

A long text meets some of these by chance.  What clean texts collect per distinct
token (unlabelled texts below the operating point) is taken off a text's sum, and
beyond ``TYPICAL`` times the usual length the rest is divided by the
square root of the excess, as chance grows with it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import PART, append_columns, remainder, slices, small_batches, table, text_parts, without

BUCKETS = 1 << 20
#: Rows to learn from at most (in expectation), chosen by a hash of the id.
POSITIVES = 8_000
UNLABELLED = 24_000
FEATURES = 4_096
PREFIXES = (4, 5, 6)
EVIDENCE = 25.0
RATIO = 4.0
THRESHOLD = 0.3
#: Texts of more than so many times the mean number of distinct tokens count as long.
TYPICAL = 4.0
#: Words that a worker remembers the weight of.
CACHE = 300_000


def features(word: str) -> list[int]:
    """Bucket numbers of a token: its bare lower-case form and its beginnings."""
    w = "".join(c for c in word.lower() if c.isalpha())
    if not w:
        return []
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (f"w {w}", *(f"p {w[:n]}" for n in PREFIXES if len(w) >= n))]


def tokens_of(text: str | None) -> set[str]:
    """The distinct tokens of a whole text; a long one is split in parts."""
    if not text:
        return set()
    if len(text) <= PART:
        return set(text.split())
    out: set[str] = set()
    for part in text_parts(text):
        out.update(part.split())
    return out


def document(text: str | None) -> dict[int, int]:
    """Feature -> number of distinct tokens that have it."""
    out: dict[int, int] = {}
    for token in tokens_of(text):
        for f in features(token):
            out[f] = out.get(f, 0) + 1
    return out


def select_features(pos: np.ndarray, unl: np.ndarray, n_pos: int, n_unl: int, size: int = FEATURES, least: float = EVIDENCE, ratio: float = RATIO) -> np.ndarray:
    """Buckets that positives have ``ratio`` times as often or more, by likelihood ratio.

    ``least`` is the smallest G statistic; with a million buckets hardly any
    reaches 25 by chance, so a model of few positives has few features.
    """
    n_pos, n_unl = max(1, n_pos), max(1, n_unl)
    p, u = pos / n_pos, unl / n_unl
    both = (pos + unl) / (n_pos + n_unl)

    def part(k, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            yes = np.where(k > 0, k * np.log(k / (n * both)), 0.0)
            no = np.where(k < n, (n - k) * np.log((n - k) / (n * (1 - both))), 0.0)
        return np.nan_to_num(yes + no)

    g = np.where((pos >= 3) & (p > ratio * u), 2 * (part(pos, n_pos) + part(unl, n_unl)), 0.0)
    best = np.argsort(-g, kind="stable")[:size]
    return np.sort(best[g[best] >= least])


def fit(rows: list[np.ndarray], cols: list[np.ndarray], vals: list[np.ndarray], sizes: list[int], width: int, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Weights and bias of a linear scorer; index 0 positives, 1 unlabelled."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)

    def scores(k):
        return w[-1] + np.bincount(rows[k], w[cols[k]] * vals[k], minlength=sizes[k])

    def back(k, slope):
        return np.append(np.bincount(cols[k], slope[rows[k]] * vals[k], minlength=width), slope.sum())

    for step in range(1, steps + 1):
        gp, gu = scores(0), scores(1)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad_rest = back(1, su / sizes[1]) - back(0, prior * sp / sizes[0])
        grad = back(0, prior * (sp - 1) / sizes[0]) + grad_rest if rest >= 0 else -grad_rest
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def operating_point(pos: np.ndarray, unl: np.ndarray, prior: float) -> float:
    """The value of g with the best F1 that positives and unlabelled rows imply.

    Recall is the share of positives at or above it; precision is the prior
    times that recall over the share of unlabelled rows there, at most 1.  The
    result lies halfway between two reached values.
    """
    at = np.unique(np.concatenate((pos, unl)))
    recall = 1 - np.searchsorted(np.sort(pos), at, side="left") / len(pos)
    share = 1 - np.searchsorted(np.sort(unl), at, side="left") / len(unl)
    precision = np.minimum(1.0, prior * recall / np.maximum(share, 1e-12))
    f1 = 2 * precision * recall / np.maximum(precision + recall, 1e-12)
    i = int(f1.argmax())
    return float(at[i] if i == 0 else (at[i - 1] + at[i]) / 2)


def background(sums: np.ndarray, tokens: np.ndarray, limit: float) -> float:
    """What unlabelled texts with a sum below ``limit`` collect per distinct token."""
    clean = sums < limit
    return max(0.0, float(sums[clean].sum() / max(1.0, tokens[clean].sum())))


class Model:
    """A linear scorer: bias + (sum of weights - slope x tokens), the latter scaled for long texts."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, slope: float = 0.0, typical: float = np.inf):
        self.of = dict(zip(chosen.tolist(), weights[:-1].tolist()))
        self.bias, self.slope, self.typical = float(weights[-1]), slope, typical

    def evidence(self, sums: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return (sums - self.slope * tokens) / np.sqrt(np.maximum(1.0, tokens / self.typical))

    def word(self, token: str) -> float:
        of = self.of
        return sum(of.get(f, 0.0) for f in features(token))

    def score(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        out, sizes = np.empty(len(texts)), np.empty(len(texts))
        get = cache.get
        for i, text in enumerate(texts):
            tokens = tokens_of(text)
            values = list(map(get, tokens))
            if None in values:
                if len(cache) > CACHE:
                    cache.clear()
                for j, (t, v) in enumerate(zip(tokens, values)):
                    if v is None:
                        values[j] = cache[t] = self.word(t)
            # The order of a set differs between processes; an exact sum does not.
            out[i], sizes[i] = _exact(values), len(tokens)
        return 1 / (1 + np.exp(-np.clip(self.bias + self.evidence(out, sizes), -50, 50)))


def _exact(values: list[float]) -> float:
    from math import fsum

    return fsum(values)


def _thinned(df: DataFrame, n: int, most: int) -> DataFrame:
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))


def train(docs: DataFrame, toxic_ids: DataFrame, prior: float, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Learn from ``docs`` (doc_id, text) and the ids of confirmed toxic rows.

    Null texts count as empty; null ids and ids without a text are not used;
    repeated rows count as often as they occur.  None if no positive is left, as
    with an empty table.  ``prior`` is the share of toxic texts.
    """
    small_batches(docs.sparkSession)
    known = toxic_ids.select("doc_id").where("doc_id is not null").distinct()
    n_pos, n_all = known.count(), docs.select("doc_id").count()
    if not n_pos:
        return None
    # The ids are thinned before they meet the texts: at most about ``positives``
    # of them are broadcast, whatever the input, and no text is shuffled.
    marked = docs.select("doc_id", "text").join(F.broadcast(_thinned(known, n_pos, positives)), "doc_id", "left_semi").select(F.lit(1).alias("y"), "text")
    rest = _thinned(docs.select("doc_id", "text"), n_all, unlabelled).select(F.lit(0).alias("y"), "text")
    sample = marked.unionByName(rest)

    def count(batches):
        sums = np.zeros((2, BUCKETS), dtype=np.int32)
        seen = [0, 0]
        for b in slices(batches, 1):
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[y, list(document(text))] += 1
                seen[y] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at.tolist()], pa.int64()), pa.array([seen[1], *sums[1, at].tolist()], pa.int64()), pa.array([seen[0], *sums[0, at].tolist()], pa.int64())],
            names=["f", "pos", "unl"],
        )

    # Of what the sample has, only what occurs among positives can be chosen.
    sums = sample.mapInArrow(count, "f bigint, pos bigint, unl bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl")).where("pos >= 3 or f = -1").toArrow()
    pos, unl = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    f = sums.column(0).to_numpy()
    pos[f], unl[f] = sums.column(1).to_numpy(), sums.column(2).to_numpy()  # -1: the last place holds row counts
    chosen = select_features(pos[:-1], unl[:-1], int(pos[-1]), int(unl[-1]))
    if not pos[-1] or not unl[-1] or not len(chosen):
        return None
    place = {b: i for i, b in enumerate(chosen.tolist())}

    def project(batches):
        for b in slices(batches, 1):
            texts = b.column(1).to_pylist()
            kept = [{place[f]: c for f, c in document(t).items() if f in place} for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([sorted(k) for k in kept], pa.list_(pa.int32())), pa.array([[k[f] for f in sorted(k)] for k in kept], pa.list_(pa.int32())),
                    pa.array([len(tokens_of(t)) for t in texts], pa.int64()),
                ],
                names=["y", "cols", "vals", "tokens"],
            )

    # At most positives + unlabelled short rows. Sorted: sums do not depend on tasks.
    found = sorted((r.y, r.cols, r.vals, r.tokens) for r in sample.mapInArrow(project, "y int, cols array<int>, vals array<int>, tokens bigint").collect())
    rows, cols, vals, sizes, tokens = [], [], [], [], []
    for y in (1, 0):
        own = [x for x in found if x[0] == y]
        sizes.append(len(own))
        rows.append(np.repeat(np.arange(len(own)), [len(x[1]) for x in own]))
        cols.append(np.array([c for x in own for c in x[1]], dtype=np.int64))
        vals.append(np.array([v for x in own for v in x[2]], dtype=np.float64))
        tokens.append(np.array([x[3] for x in own], dtype=np.float64))
    weights = fit(rows, cols, vals, sizes, len(chosen), prior)
    sums = [np.bincount(r, weights[c] * v, minlength=n) for r, c, v, n in zip(rows, cols, vals, sizes)]
    slope = background(sums[1], tokens[1], operating_point(*sums, prior))
    model = Model(chosen, weights, slope, max(1.0, TYPICAL * tokens[1].mean()))
    reached = [model.bias + model.evidence(x, n) for x, n in zip(sums, tokens)]
    model.bias += np.log(THRESHOLD / (1 - THRESHOLD)) - operating_point(*reached, prior)
    return model


def score(docs: DataFrame, model: Model | None, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1 as one more column.

    Null and empty texts have the score of no evidence; without a model all
    scores are 0.  Rows, repeated ones too, and other columns stay as they are,
    but a column of that name is replaced; no rows give no rows.  Scores of equal
    texts are equal; a long text is read word by word, and its evidence is scaled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, [column], [text])
    shipped = spark.sparkContext.broadcast(model)
    index = docs.columns.index(text)

    def run(batches):
        cache: dict[str, float] = {}
        m = shipped.value
        for b in slices(batches, index):
            texts = b.column(index).to_pylist()
            yield append_columns(b, **{column: pa.array(m.score(texts, cache) if m else np.zeros(len(texts)), pa.float64())})

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(column)).schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from the labels that are not held out.

    The class prior is the share of toxic rows among the labelled ones; without a
    toxic one nothing is learnt and all scores are 0.  Null and empty texts have the score of no evidence; a null id is not
    held out; repeated rows stay; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    # Labels of held-out rows are never read; the rows' texts are not learnt from either.
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out & F.col("toxic").isNotNull())
    prior = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).agg(F.avg("toxic")).first()[0] or 0.0
    model = train(docs.where(~held_out), labels.where("toxic = 1"), float(prior))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
