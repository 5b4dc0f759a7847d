"""Quality rules with risk-controlled cutoffs.

Signals of a text (symbols, repeats, repeated lines, upper-case words) are put on
one scale: 0 is unremarkable, 1 as bad as can be, and a text is as bad as its
worst signal.  One cutoff on that badness per stratum is calibrated on labelled
rows: cutoffs are tried from the mildest to the strictest, and the strictest is
kept whose exact upper bound (Clopper and Pearson) on the share of good texts
that it rejects stays within ``risk``, as does every milder one.  Such a fixed
sequence needs no correction among its own cutoffs; the confidence is divided by
the number of strata (Bonferroni), so with probability 1 - ``error`` the
guarantee holds in all strata at once.  A stratum with too few good texts to
prove anything rejects nothing by this rule.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ASCII_SPACE, append_columns, fresh, slices, small_batches, stored, table

RISK = 0.02
ERROR = 0.05
#: Cutoffs tried: GRID, GRID - 1, ... in GRID-ths.
GRID = 100
#: Words beyond which a text's windows are compared as numbers.
LONG = 200_000
SYMBOLS = "#*$%&|<>"
#: Where a signal starts to count, and where it is as bad as can be.
SCALES = {"symbols": (0.05, 1.0), "repeats": (0.1, 0.5), "lines": (0.1, 0.8), "upper": (0.2, 1.0)}

KIND = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")])
KIND_SQL = "struct<" + ",".join(f"{f.name}:bigint" for f in KIND) + ">"


def repeated_words(words: list[bytes]) -> int:
    """Words in a window of three that occurs twice or more."""
    if len(words) <= 3:
        return 0
    if len(words) > LONG:  # numbers for words keep a very long text small
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
        pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
        _, which, n = np.unique(pair[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
        twice = n[which] > 1
        hit = np.zeros(len(words), dtype=bool)
        for j in range(3):
            hit[j : j + len(twice)] |= twice
        return int(hit.sum())
    triples = list(zip(words, words[1:], words[2:]))
    if len(set(triples)) == len(triples):
        return 0
    once, twice, repeats = set(), set(), 0
    for t in triples:
        (twice if t in once else once).add(t)
    covered = -1  # last word counted
    for i, t in enumerate(triples):
        if t in twice:
            repeats += i + 2 - max(covered, i - 1)
            covered = i + 2
    return repeats


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``KIND``."""
    if not text:
        return (0,) * 7
    raw = text.encode("utf-8", "surrogatepass").split()
    n = len(raw)
    spaces = sum(map(text.count, ASCII_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    repeats = repeated_words(raw)
    upper = sum(map(bytes.isupper, raw))
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeats, len(lines), upper


def with_signals(docs: DataFrame, column: str, text: str = "text") -> DataFrame:
    """``docs`` with the counts of its whole texts as one more struct column."""
    small_batches(docs.sparkSession)
    index = docs.columns.index(text)

    def run(batches):
        for b in slices(batches, index):
            rows = [measure(t) for t in b.column(index).to_pylist()]
            fields = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(KIND))]
            yield append_columns(b, **{column: pa.StructArray.from_arrays(fields, fields=list(KIND))})

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast(KIND_SQL).alias(column)).schema)


def base_failed(s: Column) -> Column:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def badness(s: Column) -> Column:
    """0 to GRID: the worst of the scaled signals, rounded down."""
    words, lines = F.greatest(s.n_words, F.lit(1)), F.greatest(s.n_lines, F.lit(1))
    shares = {"symbols": s.n_symbols / words, "repeats": s.n_repeat_words / words, "lines": s.n_dup_lines / lines, "upper": s.n_upper_words / words}
    scaled = [(shares[k] - lo) / (hi - lo) for k, (lo, hi) in SCALES.items()]
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(*scaled))) * GRID).cast("int")


def binomial_cdf(k: int, n: int, p: float) -> float:
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def within(k: int, n: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound at ``error`` for k of n is at most ``risk``.

    The bound is the p at which k or fewer of n have probability ``error``; it is
    at most ``risk`` if that probability, at ``risk``, is at most ``error``.
    """
    return n > 0 and k < n and k <= risk * n and binomial_cdf(k, n, risk) <= error


def cutoff(rejected: list[int], n: int, risk: float, error: float) -> int | None:
    """The strictest proven cutoff; ``rejected[c]`` good texts have badness c."""
    best, k = None, 0
    for c in range(GRID, 0, -1):
        k += rejected[c]
        if not within(k, n, risk, error):
            break
        best = c
    return best


def stratum_key(column: str | None) -> Column:
    """A text per stratum; null is one of its own, apart from the empty text."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit("null")) if column else F.lit("all")


def calibrate(scores: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, n_good, cutoff) from ``scores`` (doc_id, stratum, bad) and labels.

    ``labels`` has doc_id and quality (1 good, 0 bad); other and null values do
    not count, and a repeated id counts once, as good if any of its labels is,
    and with the worst badness of its rows: trials must not depend on each other.
    Null ids are no trials.
    Texts that fail the base rules should not be in ``scores``: they are not
    this rule's to reject.
    """
    good = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    # One row per stratum and badness: at most GRID + 1 rows for a stratum.
    trials = scores.join(good, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("bad", "stratum")).alias("t")).select("t.*")
    counts = stored(trials.groupBy("stratum", "bad").agg(F.count("*").alias("n")), "calibration", labels.count())
    strata = counts.select("stratum").distinct().count()
    level = error / max(1, strata)

    def solve(pdf):
        rejected = [0] * (GRID + 1)
        for bad, n in zip(pdf["bad"], pdf["n"]):
            rejected[int(bad)] += int(n)
        c = cutoff(rejected, sum(rejected), risk, level)
        return pdf.iloc[:1][["stratum"]].assign(n_good=sum(rejected), cutoff=c).astype({"cutoff": "Int32"})

    return counts.groupBy("stratum").applyInPandas(solve, "stratum string, n_good bigint, cutoff int")


def judge(docs: DataFrame, labels: DataFrame, signals: str, kept: str, doc_id: str = "doc_id", stratum: str | None = "lang", text: str = "text", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``docs`` with the struct ``signals`` and the verdict ``kept`` as new columns.

    Null and empty texts have no words and fail the base rules.  A null stratum
    is a stratum of its own.  Every row keeps its place and columns, repeated
    rows included; an empty table stays empty; without labels only the base
    rules reject.
    """
    measured = stored(with_signals(docs, signals, text), "signals")
    s = F.col(f"`{signals}`")
    group = stratum_key(stratum)
    scores = measured.where(~base_failed(s)).select(F.col(doc_id).alias("doc_id"), group.alias("stratum"), badness(s).alias("bad"))
    cut, key = fresh("cutoff", measured), fresh("stratum_key", measured)
    found = calibrate(scores, labels, risk, error).where("cutoff is not null").select(F.col("stratum").alias(key), F.col("cutoff").alias(cut))
    verdict = ~base_failed(s) & F.coalesce(badness(s) < F.col(cut), F.lit(True))
    # A row per stratum with a proven cutoff; Spark broadcasts it only below its own limit.
    return measured.join(found, group == F.col(key), "left").withColumn(kept, verdict).drop(cut, key)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    Null and empty texts go, for they have no words; repeated rows share their
    fate; null ids and strata are judged like any other; no rows give no rows.
    """
    signals, kept = fresh("signals", docs), fresh("kept", docs)
    return judge(docs, labels, signals, kept, **options).where(F.col(kept)).select(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict; strata are languages.

    Null and empty texts have no words and fail; repeated rows stay; an empty
    table gives no rows; whole texts are counted, however long.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # The text itself is not needed after its counts.
    measured = stored(with_signals(docs, "s").select("doc_id", "lang", "s"), "signals")
    scores = measured.where(~base_failed(F.col("s"))).select("doc_id", stratum_key("lang").alias("stratum"), badness(F.col("s")).alias("bad"))
    found = calibrate(scores, table(spark, sf_dir, "labels"))
    failed = base_failed(F.col("s"))
    return measured.withColumn("stratum", stratum_key("lang")).join(found, "stratum", "left").select(
        "doc_id",
        *[F.col(f"s.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & F.coalesce(badness(F.col("s")) < F.col("cutoff"), F.lit(True))).alias("kept"),
        badness(F.col("s")).alias("badness"),
        "cutoff",
    )
