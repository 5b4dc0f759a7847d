"""Rules from tables: exclusions with reasons, classifiers, thresholds, aliases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """Equality on every argument that is not None."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does; a null rule does not hold."""
    out = None
    for name, rule in rules:
        out = F.when(rule, F.lit(name)) if out is None else out.when(rule, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def noise(c: Column, anchored_lower: Sequence[str], anywhere: Sequence[str], only: Column | None = None) -> Column:
    """Whether a label is noise.

    ``anchored_lower`` patterns match from the start of the lower-cased text;
    ``anywhere`` patterns are searched in the original case, and only where
    ``only`` holds.
    """
    hit = F.lower(c).rlike("^(?:" + "|".join(anchored_lower) + ")") if anchored_lower else F.lit(False)
    if anywhere:
        second = c.rlike("|".join(f"(?:{p})" for p in anywhere))
        hit = hit | (second if only is None else second & only)
    return hit


def decide(score: Column, negative: Column, agreement: Column, keep: Column, drop: Column, known: Column, margin: float = 0.0, vote: float = 0.5) -> Column:
    """Five-way decision, first rule wins.

    no_reference, drop_negative (a negative class is nearer than the own one),
    drop_far (below ``drop``), keep (at ``keep`` or above and the neighbours
    agree), else ambiguous.
    """
    return (
        F.when(~known, "no_reference")
        .when(negative > score + F.lit(margin), "drop_negative")
        .when(score < drop, "drop_far")
        .when((score >= keep) & (agreement >= vote), "keep")
        .otherwise("ambiguous")
    )


def resolve_thresholds(df: DataFrame, key: str, explicit: float | None, calibrated: DataFrame, default: float, out: str = "threshold") -> DataFrame:
    """Explicit value over the calibrated one of the key over the default.

    ``calibrated`` has the key and ``value``; ``fallback_used`` tells where the
    default applied.
    """
    joined = df.join(calibrated.select(key, F.col("value").alias("_calibrated")), key, "left")
    value = F.coalesce(F.lit(explicit).cast("double"), F.col("_calibrated"), F.lit(default))
    return joined.withColumn(out, value).withColumn("fallback_used", F.lit(explicit is None) & F.col("_calibrated").isNull()).drop("_calibrated")


def classify(df: DataFrame, name: str, exact: DataFrame, patterns: Sequence[tuple[str, str, str]], gated: Sequence[tuple[str, str, str]] = (), gate: Column | None = None) -> DataFrame:
    """Adds category and reason: exact name, then patterns, then gated patterns.

    ``exact`` has name, category and reason.  Patterns are (regex, category,
    reason); gated ones hold only where ``gate`` does.
    """
    e = exact.select(F.col("name").alias("_n"), F.col("category").alias("_c"), F.col("reason").alias("_r"))
    out = df.join(e, F.col(name) == F.col("_n"), "left")

    def pick(i: int) -> Column:
        c = F.when(F.col("_n").isNotNull(), F.col("_c" if i == 0 else "_r"))
        for p, category, reason in patterns:
            c = c.when(F.col(name).rlike(p), F.lit((category, reason)[i]))
        for p, category, reason in gated:
            c = c.when(F.col(name).rlike(p) & (F.lit(True) if gate is None else gate), F.lit((category, reason)[i]))
        return c

    return out.withColumns({"category": pick(0), "reason": pick(1)}).drop("_n", "_c", "_r")


def missing_names(listed: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Names of a rule list that do not exist."""
    return listed.select(name).join(known.select(name), name, "left_anti").distinct()


def alias_normalize(df: DataFrame, key: str, text: str, aliases: DataFrame, default: str) -> DataFrame:
    """Adds ``value``: that of the alias equal to the text, else of the longest in it.

    An alias counts where it stands between spaces or ends.  Ties go to the
    alphabetically first alias.  Texts are looked up by their word runs, so the
    join is an equality and the alias table may be large; runs are as long as
    the longest alias.
    """
    words = F.split(F.col(text), " ")
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))

    usable = [F.when(F.size(words) >= n, runs_of(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]
    found = (
        df.select(key, text, F.explode(F.array_distinct(F.concat(*usable))).alias("alias"))
        .join(aliases, "alias")
        .groupBy(key)
        .agg(F.min_by("value", F.struct(F.col("alias") != F.col(text), -F.length("alias"), "alias")).alias("value"))
    )
    return df.join(found, key, "left").withColumn("value", F.coalesce("value", F.lit(default)))


def alias_table(tables: Sequence[tuple[DataFrame, str, str]], literals: Mapping[str, str]) -> DataFrame:
    """(alias, value): lower-cased aliases of tables, then of literals; what comes first stays.

    A table is (frame, alias column, value column); of one table's equal aliases
    the smallest value stays.  Null and blank aliases are left out.
    """
    spark = tables[0][0].sparkSession
    parts = [df.select(F.lower(F.trim(F.col(a))).alias("alias"), F.col(v).alias("value"), F.lit(i).alias("_from")) for i, (df, a, v) in enumerate(tables)]
    own = spark.createDataFrame([(k.strip().lower(), v, len(tables)) for k, v in literals.items()], "alias string, value string, _from int")
    rows = reduce(lambda a, b: a.unionByName(b), [*parts, own]).where("alias <> ''")
    return rows.groupBy("alias").agg(F.min_by("value", F.struct("_from", "value")).alias("value"))
