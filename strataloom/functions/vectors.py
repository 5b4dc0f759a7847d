"""Vector expressions on ``array<float|double>``, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _given(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    A lambda computes everything in it for every element, what it does not
    depend on too; a value that is the element of an array of one is computed
    before the lambda begins.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; the zero vector stays zero."""
    return _given(norm(v), lambda n: F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def two_view(a: Column, b: Column) -> Column:
    """Direction of the sum of two unit vectors."""
    return normalize(add(a, b))


def _shares(e: Column) -> Column:
    """Non-negative entries divided by their sum."""
    return _given(e, lambda e: _given(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total)))


def softmax(v: Column) -> Column:
    return _shares(_given(F.array_max(as_double(v)), lambda top: F.transform(as_double(v), lambda x: F.exp(x - top))))


def top_k_softmax(v: Column, k: int) -> Column:
    """Softmax over the k largest entries, 0 elsewhere; ties to the lower index."""
    keyed = F.transform(as_double(v), lambda x, i: F.struct((-x).alias("m"), i.alias("i")))
    # The last of the chosen in the order (descending entry, index): all up to it are chosen.
    last = _given(F.array_sort(keyed), lambda order: F.get(order, F.least(F.lit(k), F.size(order)) - 1))

    def chosen(bound):
        return F.transform(
            as_double(v), lambda x, i: F.when((-x < bound.last.m) | ((-x == bound.last.m) & (i <= bound.last.i)), F.exp(x - bound.top)).otherwise(F.lit(0.0))
        )

    return _shares(_given(F.struct(last.alias("last"), F.array_max(as_double(v)).alias("top")), chosen))


def guided_step(x: Column, cond: Column, free: Column, guidance: float, h: float) -> Column:
    """x + h (u + g (c - u)), element by element."""
    blend = F.zip_with(as_double(cond), as_double(free), lambda c, u: u + F.lit(guidance) * (c - u))
    return F.zip_with(as_double(x), blend, lambda a, b: a + F.lit(h) * b)


def one_hot(c: Column, vocabulary: list[str]) -> Column:
    """1.0 at the value's place; all zero for an unknown value."""
    return F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.when(F.coalesce(v == c, F.lit(False)), 1.0).otherwise(0.0))


def centroid(df: DataFrame, key: str, vector: str, unit: bool = True) -> DataFrame:
    """(key, centroid): the mean vector per key, scaled to unit length.

    A null vector is left out.  One aggregation by (key, position), combined on
    the map side, and a second one that gathers a vector's entries.
    """
    by = df.select(key, F.posexplode(as_double(F.col(vector))).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    out = by.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("centroid"))
    return out.withColumn("centroid", normalize(F.col("centroid"))) if unit else out
