"""Data-quality checks: each gives rows (rule, key, detail) for what it finds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def all_of(*found: DataFrame) -> DataFrame:
    """What several checks find, none of which stops another."""
    return reduce(lambda a, b: a.unionByName(b), found)


def fail_on(found: DataFrame) -> DataFrame:
    """One row if nothing was found, an error naming the first finding if something was."""
    first = found.agg(F.min(F.concat_ws(": ", "rule", "key", "detail")).alias("f"))
    return first.select(F.when(F.col("f").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("f"))).alias("valid"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    g = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return violations(g, "duplicate", F.col(key), F.col("n"))


def first_named(found: DataFrame, n: int = 5) -> DataFrame:
    """(rule, n, first): number of findings per rule and the first few keys."""
    from .ranking import top_n

    total = found.groupBy("rule").agg(F.count("*").alias("n"))
    few = top_n(found, ["rule"], [F.col("key"), F.col("detail")], n, "_r").groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "key"))), lambda s: s.key), ",").alias("first"))
    return total.join(few, "rule")


def references(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """Keys without a partner, both ways."""
    from .sets import difference

    return violations(difference(df, other, key), "reference", F.col(key), F.col("side"))


def consistent(df: DataFrame, other: DataFrame, key: str, attribute: str) -> DataFrame:
    x = df.select(key, F.col(attribute).alias("_x")).join(other.select(key, F.col(attribute).alias("_y")), key)
    return violations(x.where(~F.col("_x").eqNullSafe(F.col("_y"))), f"inconsistent {attribute}", F.col(key), F.concat_ws(" / ", "_x", "_y"))


def complete_categories(df: DataFrame, key: str, category: str, wanted: list[str]) -> DataFrame:
    """Keys whose set of categories is not exactly the wanted one."""
    g = df.groupBy(key).agg(F.sort_array(F.collect_set(category)).alias("s"))
    return violations(g.where(F.col("s") != F.array(*map(F.lit, sorted(wanted)))), "categories", F.col(key), F.array_join("s", ","))


def uniform(df: DataFrame, key: str, *attributes: str) -> DataFrame:
    """Keys with more than one value of the attributes (nulls count as a value)."""
    g = df.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"})).alias("n"))
    return violations(g.where("n > 1"), "not uniform", F.col(key), F.col("n"))


def row_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A finding for each row and rule that does not hold; null does not hold."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key", F.lit("").alias("detail"))


def row_count(df: DataFrame, name: str, expected: Column | int) -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    wanted = expected if isinstance(expected, Column) else F.lit(expected)
    return violations(n.where(F.col("n") != wanted), "row count", F.lit(name), F.concat_ws(" / ", F.col("n"), wanted))


def permutation(df: DataFrame, group: str, rank: str, member: str) -> DataFrame:
    """Groups whose ranks are not 1..n or whose members repeat."""
    # Two groupings instead of two distinct counts, for which Spark writes every row once more each.
    ranks = df.groupBy(group, rank).agg(F.count("*").alias("_n")).groupBy(group).agg(F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.sum("_n").alias("n"), F.count(rank).alias("dr"))
    members = df.select(F.col(group).alias("_g"), F.col(member).alias("_m")).distinct().groupBy("_g").agg(F.count("_m").alias("dm"))
    g = ranks.join(members, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    bad = (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("dr") != F.col("n")) | (F.col("dm") != F.col("n"))
    return violations(g.where(bad), "permutation", F.col(group), F.concat_ws("/", "lo", "hi", "n", "dr", "dm"))


def sums_to(df: DataFrame, group: str, value: str, total: float, tolerance: float) -> DataFrame:
    g = df.groupBy(group).agg(F.sum(value).alias("s"))
    return violations(g.where(F.abs(F.col("s") - total) >= tolerance), "sum", F.col(group), F.round("s", 6))


def within_range(df: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (v < low) | (v > high)
    return violations(df.where(bad), "range", F.col(key), v)


def same_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """Groups whose member set differs from that of the first group.

    Sets are compared by count and by an order-free sum of hashes, so no set is
    gathered.
    """
    g = df.select(group, member).distinct().groupBy(group).agg(F.count("*").alias("n"), F.sum(F.xxhash64(member).cast("decimal(20,0)")).alias("h"))
    first = g.agg(F.min_by(F.struct("n", "h"), F.col(group)).alias("f"))
    out = g.join(first).where((F.col("n") != F.col("f.n")) | (F.col("h") != F.col("f.h")))
    return violations(out, "members", F.col(group), F.col("n"))


def vector_checks(df: DataFrame, key: str, vector: str, dim: int, tolerance: float = 1e-3) -> DataFrame:
    from ..functions import vectors as vx

    v = F.col(vector)
    return row_rules(df, key, {
        "dimension": F.size(v) == dim,
        "finite": ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        "unit norm": F.abs(vx.norm(v) - 1) <= tolerance,
    })


def bad_lines(lines: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    return violations(lines.where(F.col(column).rlike("|".join(f"(?:{p})" for p in patterns))), "bad line", F.col(column), F.lit(""))


def hash_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` as read by binaryFile, manifest (name, sha256)."""
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("own"))
    x = manifest.join(own, "name", "left").where(~F.col("own").eqNullSafe(F.col("sha256")))
    return violations(x, "hash", F.col("name"), F.coalesce("own", F.lit("missing")))


def required_lookup(df: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``value`` from the dimension; a missing or repeated key is an error."""
    d = dimension.groupBy(key).agg(F.count("*").alias("_n"), F.first(value).alias(value))
    out = df.join(d, key, "left")
    ok = F.when(F.col("_n") == 1, F.col(value)).otherwise(F.raise_error(F.concat(F.lit(f"{key} missing or repeated: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return out.withColumn(value, ok).drop("_n")


def to_schema(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly these columns in this order and type; an error on a missing column or a lossy type."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(ddl)
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.to(schema)
