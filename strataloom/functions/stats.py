"""Statistics as aggregate expressions over sufficient sums.

Everything is summed in double and stays one partial and one final aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(x: Column, w: Column) -> Column:
    """Null when the weights sum to 0."""
    total = F.sum(w.cast("double"))
    return F.when(total != 0, F.sum(x.cast("double") * w) / total)


def ordered_sums(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, sum, n, given, first): sums of doubles added up in the order of ``order``, and its smallest value.

    Doubles give another last digit in another order, which decides ties and what
    lies just at a limit; these sums are the same however a scan is split.
    ``n`` counts rows, ``given`` those with a value.  A group's rows are sorted in
    one task, which spills; no group is gathered.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.col(value).cast("double")
    running = rows.select(*keys, F.col(order).alias("_o"), F.sum(x).over(w).alias("_s"), F.count(x).over(w).alias("_g"), F.count(F.lit(1)).over(w).alias("_n"))
    return running.groupBy(*keys).agg(F.max_by("_s", "_n").alias("sum"), F.max("_n").alias("n"), F.max("_g").alias("given"), F.min("_o").alias("first"))


def sample_sd(x: Column) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def pearson_of_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, var_floor: float = 1e-12) -> Column:
    """Pearson from six sums, clipped to [-1, 1].

    Null below two pairs, or when a side's sum of squares about its mean is at
    most ``var_floor`` of max(its sum of squares, 1).
    """
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    valid = (n >= 2) & (vx > F.greatest(sxx, F.lit(1.0)) * var_floor) & (vy > F.greatest(syy, F.lit(1.0)) * var_floor)
    r = (sxy - sx * sy / n) / F.sqrt(vx * vy)
    return F.when(valid, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson(x: Column, y: Column, var_floor: float = 1e-12) -> Column:
    """``pearson_of_sums`` over rows; pairs with a null side do not count."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    return pearson_of_sums(F.count(a), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b), var_floor)


def average_rank(order: Column, *partition: Column) -> Column:
    """1-based ascending rank; equal values share the mean of their places."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, order)) - 1) / 2.0


def masked_sums(pred: Column, target: Column, mask: Column) -> dict[str, Column]:
    """SSE, SAE and number of measured cells."""
    d = F.when(mask, pred.cast("double") - target)
    return {"sse": F.coalesce(F.sum(d * d), F.lit(0.0)), "sae": F.coalesce(F.sum(F.abs(d)), F.lit(0.0)), "n": F.count(d)}


def masked_metrics(cells: DataFrame, unit: str, item: str, pred: str, target: str, mask: str, var_floor: float = 1e-12) -> DataFrame:
    """Per (unit, item): sse, sae, n, sum of squares of the target, pearson, constant flags."""
    m = F.col(mask)
    p, y = F.when(m, F.col(pred).cast("double")), F.when(m, F.col(target).cast("double"))
    return cells.groupBy(unit, item).agg(
        *[c.alias(k) for k, c in masked_sums(F.col(pred), F.col(target), m).items()],
        F.coalesce(F.sum(y * y), F.lit(0.0)).alias("energy"),
        pearson(p, y, var_floor).alias("pcc"),
        (F.min(y) == F.max(y)).alias("constant_target"),
        (F.min(p) == F.max(p)).alias("constant_pred"),
    )


def per_unit(metrics: DataFrame, unit: str) -> DataFrame:
    """Item metrics to one row per unit: micro errors, macro correlations, counts."""
    n = F.sum("n")
    return metrics.groupBy(unit).agg(
        n.alias("n"),
        F.sum("sse").alias("sse"),
        F.sum("sae").alias("sae"),
        (F.sum("sse") / F.nullif(n, F.lit(0))).alias("mse"),
        F.sqrt(F.sum("sse") / F.nullif(n, F.lit(0))).alias("rmse"),
        (F.sum("sae") / F.nullif(n, F.lit(0))).alias("mae"),
        F.avg("pcc").alias("mean_pcc"),
        F.median("pcc").alias("median_pcc"),
        F.count_if(F.col("n") > 0).alias("measured"),
        F.count("pcc").alias("valid_pcc"),
        F.count_if(F.col("constant_target")).alias("constant_target"),
        F.count_if(F.col("constant_pred")).alias("constant_pred"),
    )


def evaluate(rows: DataFrame, settings: list[str], unit: str, item: str, pred: str, target: str, mask: str) -> DataFrame:
    """Per run settings: the metrics of all units (micro errors, mean and median correlation, counts).

    A row is one cell of one run; every combination of ``settings`` is a run.
    """
    whole = F.struct(*settings, F.col(unit).alias("_unit"))
    units = per_unit(masked_metrics(rows.withColumn("_run", whole), "_run", item, pred, target, mask), "_run")
    n = F.sum("n")
    return units.groupBy(*[F.col(f"_run.{s}").alias(s) for s in settings]).agg(
        n.alias("n"), (F.sum("sse") / F.nullif(n, F.lit(0))).alias("mse"), F.sqrt(F.sum("sse") / F.nullif(n, F.lit(0))).alias("rmse"), (F.sum("sae") / F.nullif(n, F.lit(0))).alias("mae"),
        F.avg("mean_pcc").alias("mean_pcc"), F.median("mean_pcc").alias("median_pcc"), F.count("*").alias("units"),
    )
