"""Grouped summaries: coverage, centroids, clusters, mentions, routing."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import text as tx
from ..functions import vectors as vx
from ..storage import stored
from . import joins as jo
from . import ranking


#: Most frequent entities whose later documents are left out before documents are ranked (about 1 MB to each task).
FREQUENT = 10_000


def coverage(rows: DataFrame, group: str, key: str, is_left: Column, is_right: Column, sim: Column) -> DataFrame:
    """Per group: distinct ids on each side, matched, only on one side, mean sim, recall.

    Recall is the share of left ids that are matched, 0 when there are none.
    """
    both = is_left & is_right
    seen = {"n_left": is_left, "n_right": is_right, "n_matched": both, "only_left": is_left & ~is_right, "only_right": is_right & ~is_left}
    # One row an id first, so that no row is expanded for the distinct counts.
    value = F.when(both, sim).cast("double")
    per = rows.groupBy(group, key).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in seen.items()], F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    out = per.groupBy(group).agg(*[F.count_if(F.col(n) & F.col(key).isNotNull()).alias(n) for n in seen], F.coalesce(F.try_divide(F.sum("_sum"), F.sum("_count")), F.lit(0.0)).alias("mean_sim"))
    out = out.withColumn("recall", F.coalesce(F.try_divide("n_matched", "n_left"), F.lit(0.0)))
    median = ranking.quantiles(rows.select(group, F.when(both, sim).alias("_s")), [group], "_s", {"median_sim": 0.5})
    return ranking._with(out, median.withColumn("median_sim", F.coalesce("median_sim", F.lit(0.0))), [group])


def quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact p25, p50, p75 and p90 with linear interpolation, 0 for a group of nulls."""
    names = {f"p{p}": p / 100 for p in (25, 50, 75, 90)}
    return ranking.quantiles(df, [group], value, names).select(group, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def pairwise_percentile(df: DataFrame, group: str, key: str, vector: str, p: float) -> DataFrame:
    """(group, p, n_pairs): exact percentile of the cosine similarities of all pairs of a group.

    No pair is written: blocks of products count similarities in bins, and a
    second pass keeps only those of the bins in which the percentile lies.
    Groups of fewer than two rows have no row.
    """
    counts = jo.similarity_counts(df, key, vector, group).groupBy("g", "bin").agg(F.sum("n").alias("n"))
    counts = stored(counts, "bins")
    w = Window.partitionBy("g").orderBy("bin")  # at most ``BINS`` rows a group
    placed = counts.withColumn("before", F.sum("n").over(w) - F.col("n"))
    total = counts.groupBy("g").agg(F.sum("n").alias("n_pairs")).withColumn("at", (F.col("n_pairs") - 1) * F.lit(p))
    asked = placed.join(total, "g").where((F.ceil("at") >= F.col("before")) & (F.floor("at") < F.col("before") + F.col("n")))
    asked = stored(asked.select("g", "bin", "before", "at", "n_pairs"), "asked")
    wanted = {g: sorted(bins) for g, bins in asked.groupBy("g").agg(F.collect_list("bin")).collect()}  # a bin or two a group
    values = jo.similarity_values(df, key, vector, group, wanted)
    rank = F.row_number().over(Window.partitionBy("g").orderBy("sim")) - 1
    start = asked.groupBy("g").agg(F.min("before").alias("before"), F.first("at").alias("at"), F.first("n_pairs").alias("n_pairs"))
    rows = values.withColumn("r", rank).join(start, "g").withColumn("r", F.col("r") + F.col("before"))
    low, high = (F.max(F.when(F.col("r") == f("at"), F.col("sim"))) for f in (F.floor, F.ceil))
    out = rows.groupBy("g", "n_pairs", "at").agg((low + (high - low) * (F.col("at") - F.floor("at"))).alias("p"))
    names = df.select(F.col(group).alias("_key"), F.col(group).cast("string").alias("g")).distinct()
    return names.join(out, "g").select(F.col("_key").alias(group), "p", "n_pairs")


def medoid_centroid(df: DataFrame, group: str, key: str, vector: str, k: int) -> DataFrame:
    """Unit mean of the k rows of a group that are on average most similar to it.

    The mean similarity of a unit vector to its group is its product with the
    group's mean of unit vectors, so no pairs are made.  Ties go to the smaller id.
    """
    unit = df.select(F.col(group), F.col(key), vx.normalize(F.col(vector)).alias("_u"))
    mean = vx.centroid(unit, group, "_u", unit=False).withColumnRenamed("centroid", "_m")
    w = Window.partitionBy(group).orderBy(F.desc("_s"), key)
    best = unit.join(mean, group).withColumn("_s", F.round(vx.dot(F.col("_u"), F.col("_m")), 12)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return vx.centroid(best, group, "_u")


def pick_canonical(df: DataFrame, cluster: str, key: str, label: str, source: str, priority: list[str]) -> DataFrame:
    """(cluster, id, label): best source, then shortest label, then smallest id."""
    order = F.struct(tx.priority_rank(F.col(source), priority), F.length(label), F.col(key))
    return df.groupBy(cluster).agg(F.min_by(F.struct(F.col(key).alias("id"), F.col(label).alias("label")), order).alias("w")).select(cluster, "w.id", "w.label")


def merge_cluster(df: DataFrame, cluster: str, key: str, label: str, synonyms: str, definition: str, canonical: DataFrame) -> DataFrame:
    """(cluster, id, label, synonyms, definition) of merged clusters.

    Synonyms are those of all members and the labels of the others, distinct and
    sorted by lower case without the label itself; the definition is the longest
    (ties: alphabetically first).  A member's terms are grouped as rows, so only
    distinct terms meet.
    """
    members = df.join(canonical.select(cluster, F.col("id"), F.col("label").alias("_label")), cluster)
    terms = members.select(cluster, "_label", F.explode(F.concat(F.coalesce(synonyms, F.array().cast("array<string>")), F.array(label))).alias("t"))
    terms = terms.where((F.trim("t") != "") & (F.lower(F.trim("t")) != F.lower("_label")))
    # Of spellings that differ by case the smallest stays.
    spelled = terms.groupBy(cluster, F.lower(F.trim("t")).alias("k")).agg(F.min(F.trim("t")).alias("t"))
    lists = spelled.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda s: s.t).alias("synonyms"))
    text = members.groupBy(cluster, "id", F.col("_label").alias("label")).agg(F.min_by(definition, F.struct(-F.length(definition), F.col(definition))).alias("definition"))
    return text.join(lists, cluster, "left").select(cluster, "id", "label", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), "definition")


def mentions(df: DataFrame, form: str, normal: str, tier: str, doc: str, position: str, least: int, most_ids: int, query: str | None = None, most_synonyms: int = 20) -> DataFrame:
    """Mentions to entities: (normal, tier, n, label, synonyms, forms, doc_ids), and queries with ``query``.

    Mentions are seen in the order of (doc, position).  Entities with fewer than
    ``least`` are dropped.  The label is the most frequent form, then the
    shortest, then the first seen; synonyms are the other forms as first seen, at
    most ``most_synonyms`` of ``forms``; ``doc_ids`` are the first distinct ones,
    at most ``most_ids``.  Mentions with a null normal form or tier are not
    counted.  ``queries`` is the sorted union of the names in ``query`` over all
    mentions; names are few.
    """
    key, names = [normal, tier], [query] if query else []
    rows = df.where(F.col(normal).isNotNull() & F.col(tier).isNotNull())
    # Mentions are grouped where they are read; of documents each task passes on an entity's first ones alone.
    counted = stored(rows.groupBy(*key, form, *names).agg(F.count("*").alias("_n"), F.min(_place(df, doc, position)).alias("_first"), F.min(doc).alias("_doc")), "mentions")
    union = [F.array_sort(F.collect_set(query)).alias("queries")] if query else []
    # The first documents of an entity by form and query: none of its most_ids first ones is beyond as many of them.
    upto = F.get(F.array_sort(F.collect_set("_doc")), most_ids - 1).alias("_upto")
    known = stored(counted.groupBy(*key).agg(F.sum("_n").alias("n"), upto, *union).where(F.col("n") >= least), "entities")
    alive = known.drop("_upto")
    live = counted.join(alive.select(*key), key, "left_semi")
    forms = stored(live.groupBy(*key, form).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first")), "forms")
    per = forms.groupBy(*key).agg(F.min_by(form, F.struct(-F.col("_n"), F.length(form), F.col("_first"))).alias("label"), F.count("*").alias("forms"))
    # The label is one of the forms, so one more than is kept is enough.
    seen = forms.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_first", form))).where(F.col("_r") <= most_synonyms + 1)
    seen = seen.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(form).alias("f")))), lambda s: s["f"]).alias("_seen"))
    frequent = known.where("_upto is not null").orderBy(F.desc("n"), *key).limit(FREQUENT).select(*key, "_upto")
    near = rows.select(*key, doc).join(F.broadcast(frequent), key, "left").where(F.col("_upto").isNull() | F.col(doc).isNull() | (F.col(doc) <= F.col("_upto"))).drop("_upto")
    ids = near.withColumn("_r", F.dense_rank().over(Window.partitionBy(*key).orderBy(doc))).where(F.col("_r") <= most_ids)
    ids = ids.groupBy(*key).agg(F.array_sort(F.collect_set(doc)).alias("doc_ids"))
    out = alive.join(per, key).join(seen, key).join(ids, key)
    synonyms = F.slice(F.filter("_seen", lambda f: f != F.col("label")), 1, most_synonyms)
    return out.select(*key, "n", "label", synonyms.alias("synonyms"), "forms", "doc_ids", *(["queries"] if query else []))


def _place(df: DataFrame, doc: str, position: str) -> Column:
    """Orders rows by (doc, position), nulls first; a number if both are, since Spark sorts all rows for the minimum of a struct."""
    kinds = [df.schema[c].dataType.typeName() for c in (doc, position)]
    if kinds[0] not in ("byte", "short", "integer", "long") or kinds[1] not in ("byte", "short", "integer"):
        return F.struct(doc, position)
    at = F.coalesce(F.col(position).cast("decimal(10,0)"), F.lit(Decimal(-(2**31) - 1)))
    return F.coalesce(F.col(doc).cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1))) * F.lit(Decimal(2**33)) + at


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean and population deviation over contexts."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def summary(df: DataFrame, keys: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """mean, sd, median, min, max and counts above thresholds."""
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), st.sample_sd(F.col(value)).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        *[F.count_if(F.col(value) > x).alias(f"above_{str(x).replace('.', '_')}") for x in thresholds],
    )
    return ranking._with(out, ranking.quantiles(df, keys, value, {"median": 0.5}), keys)


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, population sd, RMS, share of zeros, quantiles, min, max."""
    v = F.col(value).cast("double")
    out = df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg((v == 0).cast("double")).alias("zeros"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    return ranking._with(out, ranking.quantiles(df, keys, value, {f"q{q}": q / 100 for q in (50, 90, 95, 99)}), keys)


def dominant(df: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """(member, n): in how many groups the member has the largest value; 0 if in none.

    Ties go to the smaller member.
    """
    best = df.groupBy(group).agg(F.min_by(member, F.struct(-F.col(value), F.col(member))).alias(member)).groupBy(member).agg(F.count("*").alias("n"))
    return df.select(member).distinct().join(best, member, "left").select(member, F.coalesce("n", F.lit(0)).alias("n"))


def share_and_rank(df: DataFrame, key: str, error: str, n: str, score: str) -> DataFrame:
    """Share of the total squared error, rank by worst error, rank by best score.

    The table is ranked as a whole, in ranges of the values.
    """
    df = stored(df, "errors")  # every rank reads it twice
    total = df.agg(F.sum(F.col(error) * F.col(n)).alias("_t"))  # one row
    out = df.join(total).withColumn("share", F.col(error) * F.col(n) / F.col("_t")).drop("_t")
    out = ranking.spread_tied_rank(out, [], error, "error_rank", average=False, descending=True)
    return ranking.spread_tied_rank(out, [], score, "score_rank", average=False, descending=True)


def load_balance(df: DataFrame, expert: str, prob: str, dispatched: str) -> DataFrame:
    """Experts x sum over experts of mean probability x share of dispatched rows."""
    per = df.groupBy(expert).agg(F.avg(prob).alias("p"), F.sum(dispatched).alias("d"))
    return per.agg((F.count("*") * F.sum(F.col("p") * F.col("d")) / F.sum("d")).alias("balance"))
