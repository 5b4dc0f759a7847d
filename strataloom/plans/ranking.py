"""Ranking, ordering and sampling (W, O, P01-P02) on the driver tables."""

from pyspark.sql import functions as F

from ..functions import stats as st
from ..operators import lexicon, ranking, sampling
from ..operators.profiles import top_two
from .registry import query


@query("w01_row_number", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def w01(t):
    return ranking.spread_rank(t.events, ["event_type"], [F.desc("value"), F.col("event_id")]).select("event_type", "event_id", "rank")


@query("w02_avg_rank", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events")
def w02(t):
    return ranking.spread_tied_rank(t.events, ["event_type"], "value").select("event_id", "rank")


@query("w03_topn", "SELECT p_type, p_partkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 5")
def w03(t):
    return ranking.top_n(t.part, ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 5).select("p_type", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query(
    "w04_two_ranks",
    "SELECT p_brand, row_number() OVER (ORDER BY a DESC, p_brand) AS by_mean, row_number() OVER (ORDER BY b DESC, p_brand) AS by_weighted FROM (SELECT p_brand, round(avg(p_retailprice), 6) AS a, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS b FROM part GROUP BY 1)",
)
def w04(t):
    m = t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("a"), F.round(st.weighted_mean(F.col("p_retailprice"), F.col("p_size")), 6).alias("b"))
    m = ranking.ranked(m.withColumn("_all", F.lit(1)), ["_all"], [F.desc("a"), F.col("p_brand")], "by_mean")
    m = ranking.ranked(m, ["_all"], [F.desc("b"), F.col("p_brand")], "by_weighted")
    return m.select("p_brand", F.col("by_mean").cast("long").alias("by_mean"), F.col("by_weighted").cast("long").alias("by_weighted"))


@query("w05_multikey_rank", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_discount DESC, l_tax DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rank FROM lineitem")
def w05(t):
    order = [F.desc("l_quantity"), F.desc("l_discount"), F.desc("l_tax"), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))]
    return ranking.ranked(t.lineitem, ["l_suppkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", F.col("rank").cast("long").alias("rank"))


@query("w06_topk_patches", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 8")
def w06(t):
    return ranking.top_n(t.events, ["user_id", "event_type"], [F.desc("value"), F.col("event_id")], 8).select("user_id", "event_type", "event_id")


_V = "[l_quantity / 10, l_discount * 20, l_tax * 30]"


@query(
    "w07_top2_in_row",
    f"""WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, i, {_V}[i + 1] AS x FROM lineitem, unnest(range(0, 3)) AS t(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax ORDER BY x DESC, i) AS r FROM u)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, max(i) FILTER (r = 1)::INT AS first, max(i) FILTER (r = 2)::INT AS second FROM r GROUP BY ALL""",
)
def w07(t):
    v = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 20, F.col("l_tax") * 30)
    first, second = top_two(v)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
    return t.lineitem.select(*keys).distinct().select(*keys, first.alias("first"), second.alias("second"))


@query(
    "w08_topn_presence",
    "SELECT p_brand, count(*) FILTER (r <= 3) AS n_top, count(*) AS n_groups FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_type ORDER BY m DESC, p_brand) AS r FROM (SELECT p_type, p_brand, round(avg(p_retailprice), 6) AS m FROM part GROUP BY ALL)) GROUP BY 1",
)
def w08(t):
    m = t.part.groupBy("p_type", "p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("m"))
    return ranking.presence(m, ["p_type"], ["p_brand"], [F.desc("m"), F.col("p_brand")], 3)


@query("w09_mint_ids", "SELECT p_partkey, upper(p_type) || '-' || lpad((row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) + 99)::VARCHAR, 5, '0') AS minted FROM part")
def w09(t):
    return ranking.mint_ids(t.part, "p_type", [F.col("p_name"), F.col("p_partkey")], start=100, fixed=True).select("p_partkey", "minted")


@query(
    "w10_keep_first",
    "SELECT doc_id AS dropped, first_value(doc_id) OVER w AS kept FROM documents WINDOW w AS (PARTITION BY lang, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY source <> 'src0', doc_id) QUALIFY row_number() OVER w > 1",
)
def w10(t):
    from ..functions import text as tx

    group = [F.col("lang"), F.sha2(tx.normalize_name(F.col("text")), 256)]
    return lexicon.dedup_mapping(t.documents, "doc_id", group, [(F.col("source") != "src0").asc(), F.col("doc_id")])


_DAILY = "SELECT event_type, date_trunc('day', ts)::DATE AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL"


@query(
    "w11_hysteresis_best",
    f"""WITH RECURSIVE d AS ({_DAILY}), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d),
f AS (SELECT event_type, i, day, v, v AS best, true AS ok FROM n WHERE i = 1
  UNION ALL SELECT n.event_type, n.i, n.day, n.v, CASE WHEN n.v < f.best - 0.5 THEN n.v ELSE f.best END, n.v < f.best - 0.5 FROM f JOIN n ON n.event_type = f.event_type AND n.i = f.i + 1)
SELECT event_type, day AS step, v AS value FROM f WHERE ok""",
)
def w11(t):
    d = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return ranking.running_best(d, ["event_type"], "day", "v", 0.5).select("event_type", "step", "value")


@query("w12_contiguity", "SELECT conv_id FROM (SELECT conv_id, CASE WHEN conv_id % 3 = 1 AND turn = 1 THEN 7 ELSE turn END AS turn FROM conversations) GROUP BY 1 HAVING min(turn) <> 0 OR max(turn) - min(turn) + 1 <> count(turn) OR count(turn) <> count(DISTINCT turn)")
def w12(t):
    moved = F.when((F.col("conv_id") % 3 == 1) & (F.col("turn") == 1), 7).otherwise(F.col("turn"))
    return ranking.gaps(t.conversations.withColumn("turn", moved), ["conv_id"], "turn", 0).select("conv_id")


@query("w13_batches", "SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 64 AS batch FROM events")
def w13(t):
    return ranking.batches(t.events, ["event_type"], [F.col("event_id")], 64).select("event_type", "event_id", "batch")


@query("o01_multikey_sort", "SELECT p_partkey, p_type, p_brand FROM part ORDER BY p_type, p_brand, p_partkey")
def o01(t):
    return t.part.orderBy("p_type", "p_brand", "p_partkey").select("p_partkey", "p_type", "p_brand")


@query("o02_mixed_sort", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def o02(t):
    return t.customer.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").select("c_mktsegment", "c_acctbal", "c_custkey")


@query("o03_hardest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
def o03(t):
    return sampling.hardest(t.customer, "c_acctbal", "c_custkey", 20).select("c_custkey", "c_acctbal")


@query("o04_partial_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def o04(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey", "o_totalprice")


@query("o05_stratified_sample", "SELECT c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':42'), c_custkey) <= 10")
def o05(t):
    return sampling.per_stratum(t.customer, "c_mktsegment", "c_custkey", 42, 10).select("c_custkey")


@query(
    "o06_rate_sample",
    "WITH n AS (SELECT c_nationkey, greatest(1, floor(count(*) * 0.1)) AS n FROM customer GROUP BY 1) SELECT c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || ':3'), c_custkey) AS r FROM customer) JOIN n USING (c_nationkey) WHERE r <= n",
)
def o06(t):
    return sampling.at_rate(t.customer, "c_nationkey", "c_custkey", 3, 0.1).select("c_custkey")


@query(
    "o07_stratified_cap",
    "SELECT c_custkey FROM (SELECT c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || ':9'), c_custkey) <= ceil(60 / (SELECT count(DISTINCT c_nationkey) FROM customer))) ORDER BY md5(c_custkey || ':9'), c_custkey LIMIT 60",
)
def o07(t):
    return sampling.capped(t.customer, "c_nationkey", "c_custkey", 9, 60).select("c_custkey")


@query("o08_casefold_array_sort", "SELECT p_size, string_agg(x, '|' ORDER BY lower(x), x) AS names FROM (SELECT DISTINCT p_size, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS x FROM part) GROUP BY 1")
def o08(t):
    from ..functions import text as tx

    x = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return t.part.groupBy("p_size").agg(F.collect_set(x).alias("s")).select("p_size", F.array_join(tx.sort_by_lower(F.col("s")), "|").alias("names"))


_CORR = "CASE WHEN n >= 2 AND vx > greatest(sxx, 1) * 1e-12 AND vy > greatest(syy, 1) * 1e-12 THEN round((sxy - sx * sy / n) / sqrt(vx * vy), 6) END"


def _corr_sql(source):
    return f"""SELECT g, {_CORR} AS r FROM (SELECT *, sxx - sx * sx / n AS vx, syy - sy * sy / n AS vy FROM (SELECT g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM ({source}) GROUP BY g))"""


@query("p01_pearson", _corr_sql("SELECT l_suppkey AS g, l_quantity AS x, CASE WHEN l_suppkey = 5 THEN 1.0 ELSE l_extendedprice END AS y FROM lineitem"))
def p01(t):
    y = F.when(F.col("l_suppkey") == 5, 1.0).otherwise(F.col("l_extendedprice"))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("g")).agg(F.round(st.pearson(F.col("l_quantity"), y), 6).alias("r"))


_RANK = "rank() OVER (PARTITION BY l_suppkey ORDER BY {0}) + (count(*) OVER (PARTITION BY l_suppkey, {0}) - 1) / 2.0"


@query("p02_spearman", _corr_sql(f"SELECT l_suppkey AS g, {_RANK.format('l_quantity')} AS x, {_RANK.format('l_extendedprice')} AS y FROM lineitem"))
def p02(t):
    rows = ranking.by_size(t.lineitem.select("l_suppkey", "l_quantity", "l_extendedprice"), ["l_suppkey"])
    r = rows.select(F.col("l_suppkey").alias("g"), st.average_rank(F.col("l_quantity"), F.col("l_suppkey")).alias("x"), st.average_rank(F.col("l_extendedprice"), F.col("l_suppkey")).alias("y"))
    return r.groupBy("g").agg(F.round(st.pearson(F.col("x"), F.col("y")), 6).alias("r"))


@query("p03_safe_moments", "SELECT p_partkey % 1500 AS g, round(avg(p_retailprice), 6) AS mean, round(coalesce(stddev_samp(p_retailprice), 0), 6) AS sd FROM part GROUP BY 1")
def p03(t):
    return t.part.groupBy((F.col("p_partkey") % 1500).alias("g")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(st.sample_sd(F.col("p_retailprice")), 6).alias("sd"))
