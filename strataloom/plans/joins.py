"""Joins (J) on the driver tables."""

from pyspark.sql import functions as F

from ..operators import joins as jo
from .registry import query

_SIM = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query("j01_dimension_lookup", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j01(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query(
    "j02_composite_key_join",
    """SELECT a.l_orderkey, a.l_linenumber, a.n AS n_x, b.n AS n_y FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) a
JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b USING (l_orderkey, l_linenumber)""",
)
def j02(t):
    def side(flag, name):
        return t.lineitem.where(F.col("l_returnflag") == flag).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias(name))

    return side("A", "n_x").join(side("R", "n_y"), ["l_orderkey", "l_linenumber"])


@query("j03_orphans", "SELECT count(*) AS orphans FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL")
def j03(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").where("c_custkey is null").agg(F.count("*").alias("orphans"))


@query("j04_metrics_metadata", "SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j04(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_mktsegment")


@query("j05_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j05(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j06_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j06(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("j07_map_join", "SELECT c_custkey, coalesce(r.x, 'other') AS x FROM customer LEFT JOIN (VALUES ('MACHINERY', 'm'), ('FURNITURE', 'f')) r(s, x) ON c_mktsegment = s")
def j07(t):
    names = t.spark.createDataFrame([("MACHINERY", "m"), ("FURNITURE", "f")], "c_mktsegment string, x string")
    return t.customer.join(names, "c_mktsegment", "left").select("c_custkey", F.coalesce("x", F.lit("other")).alias("x"))


@query("j08_required_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j08(t):
    from ..operators.checks import required_lookup

    return required_lookup(t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.nation, "n_nationkey", "n_name").select("s_suppkey", "n_name")


@query("j09_threshold_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_SIM}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_SIM} >= 0.3")
def j09(t):
    e = t.embeddings
    return jo.threshold_pairs(e, e, 0.3, "vec_id", "embedding", group="label", unordered=True).select("a", "b", F.round("sim", 6).alias("sim"))


@query("j10_cross_label_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_SIM}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.label <> b.label AND a.vec_id < b.vec_id WHERE {_SIM} >= 0.35")
def j10(t):
    e = t.embeddings
    return jo.threshold_pairs(e, e, 0.35, "vec_id", "embedding", differ="label", unordered=True).select("a", "b", F.round("sim", 6).alias("sim"))


@query(
    "j11_nearest_other_label",
    f"""WITH s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, {_SIM} AS sim FROM embeddings a JOIN embeddings b ON a.label <> b.label)
SELECT id, neighbour, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS r FROM s) WHERE r = 1""",
)
def j11(t):
    e = t.embeddings
    return jo.knn(e, e, 1, "vec_id", "embedding", differ="label").select("id", "neighbour", F.round("sim", 6).alias("sim"))


@query(
    "j11b_nearest_within_tier",
    f"""WITH s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, {_SIM} AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 2 = 0 WHERE a.vec_id % 2 = 1)
SELECT id, neighbour, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS r FROM s) WHERE r = 1""",
)
def j11b(t):
    e = t.embeddings
    return jo.knn(e.where("vec_id % 2 = 1"), e.where("vec_id % 2 = 0"), 1, "vec_id", "embedding", group="label").select("id", "neighbour", F.round("sim", 6).alias("sim"))


@query(
    "j12_knn_agreement",
    f"""WITH s AS (SELECT a.vec_id AS id, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS r
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT id, round(avg(same::INT::DOUBLE), 6) AS agreement FROM s WHERE r <= 10 GROUP BY id""",
)
def j12(t):
    return jo.knn_agreement(t.embeddings, 10, "vec_id", "embedding", "label").select("id", F.round("agreement", 6).alias("agreement"))


@query(
    "j13_spatial_knn",
    """WITH p AS (SELECT event_type AS g, event_id AS id, (event_id * 7919 % 1009)::DOUBLE AS x, (user_id * 104729 % 997)::DOUBLE AS y FROM events),
d AS (SELECT a.g, a.id, b.id AS neighbour, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id)
SELECT g AS "group", id, neighbour, d2, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY d2, neighbour) AS r FROM d) WHERE r <= 5""",
)
def j13(t):
    p = t.events.select(
        F.col("event_type").alias("g"), F.col("event_id").alias("id"), (F.col("event_id") * 7919 % 1009).cast("double").alias("x"), (F.col("user_id") * 104729 % 997).cast("double").alias("y")
    )
    return jo.spatial_knn(p, 5, None, "id", "g").withColumn("rank", F.col("rank").cast("long"))


@query(
    "j14_grid_neighbours",
    """WITH c AS (SELECT l_suppkey % 3 AS g, l_partkey % 40 AS x, l_orderkey % 37 AS y, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT a.g, a.x, a.y, round(avg(b.v), 6) AS mean FROM c a JOIN c b ON a.g = b.g AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL""",
)
def j14(t):
    c = t.lineitem.groupBy((F.col("l_suppkey") % 3).alias("g"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_orderkey") % 37).alias("y")).agg(F.sum("l_quantity").alias("v"))
    return jo.grid_mean(c, "g", "x", "y", "v").withColumn("mean", F.round("mean", 6))


@query("j15_pair_self_join", "SELECT a.n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b, a.n_name AS n_name_a, b.n_name AS n_name_b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j15(t):
    return jo.ordered_pairs(t.nation, ["n_regionkey"], "n_nationkey", ["n_name"])


_SPLIT = "CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END"


@query(
    "j16_cross_split_leak",
    f"""WITH d AS (SELECT doc_id, {_SPLIT} AS split, sha256(text) AS h, lang FROM documents)
SELECT doc_id, split, class, n_links FROM (SELECT doc_id, split, min(doc_id) OVER (PARTITION BY h, lang) AS class, count(*) OVER (PARTITION BY h, lang) - count(*) OVER (PARTITION BY h, lang, split) AS n_links FROM d WHERE h IS NOT NULL AND lang IS NOT NULL) WHERE n_links > 0""",
)
def j16(t):
    d = t.documents.select("doc_id", F.expr(_SPLIT).alias("split"), F.sha2("text", 256).alias("h"), "lang")
    return jo.leaks(d, "doc_id", "split", ["h", "lang"])


@query("j17_template_cross", "SELECT p_partkey, species, p_name || ' in ' || species AS prompt FROM part, (VALUES ('human'), ('mouse')) s(species)")
def j17(t):
    return t.part.select("p_partkey", "p_name", F.explode(F.array(F.lit("human"), F.lit("mouse"))).alias("species")).select(
        "p_partkey", "species", F.concat("p_name", F.lit(" in "), "species").alias("prompt")
    )


@query(
    "j18_positional_join",
    """WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place, l_partkey FROM lineitem)
SELECT l_orderkey, place, l_partkey AS "left", l_partkey + 1 AS "right" FROM a WHERE place = 2 AND l_orderkey % 5 = 0 UNION ALL SELECT l_orderkey, place, l_partkey, NULL FROM a WHERE place = 3 AND l_orderkey % 5 = 1""",
)
def j18(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    a = t.lineitem.select("l_orderkey", F.row_number().over(w).cast("long").alias("place"), "l_partkey")
    # The other table has a value changed in some orders and a row less in others.
    order = F.col("l_orderkey") % 5
    b = a.withColumn("l_partkey", F.col("l_partkey") + F.when((order == 0) & (F.col("place") == 2), 1).otherwise(0)).where((order != 1) | (F.col("place") != 3))
    return jo.same_order(a, b, ["l_orderkey", "place"], "l_partkey")


@query(
    "j19_dense_mask",
    """WITH v AS (SELECT o_custkey AS patch, o_orderpriority AS gene, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT p.patch, g.gene, round(coalesce(v.v, 0), 2) AS value, (v.v IS NOT NULL)::INT AS mask FROM (SELECT DISTINCT patch FROM v) p CROSS JOIN (SELECT DISTINCT gene FROM v) g LEFT JOIN v ON v.patch = p.patch AND v.gene = g.gene""",
)
def j19(t):
    v = t.orders.groupBy(F.col("o_custkey").alias("patch"), F.col("o_orderpriority").alias("gene")).agg(F.sum("o_totalprice").alias("v"))
    return jo.dense(v, v, v, "patch", "gene", "v").withColumn("value", F.round("value", 2))


@query(
    "p06_unmeasured_null",
    """WITH v AS (SELECT o_custkey AS patch, o_orderpriority AS gene, count(*)::DOUBLE AS v FROM orders GROUP BY ALL)
SELECT p.patch, g.gene, v.v AS value FROM (SELECT DISTINCT patch FROM v) p CROSS JOIN (SELECT DISTINCT gene FROM v) g LEFT JOIN v ON v.patch = p.patch AND v.gene = g.gene""",
)
def p06(t):
    v = t.orders.groupBy(F.col("o_custkey").alias("patch"), F.col("o_orderpriority").alias("gene")).agg(F.count("*").cast("double").alias("v"))
    return jo.dense(v, v, v, "patch", "gene", "v", None).select("patch", "gene", "value")


@query("p07_list_positions", "SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS position FROM (SELECT DISTINCT p_brand FROM part) QUALIFY p_brand IN ('Brand#7', 'Brand#3', 'Brand#12')")
def p07(t):
    listed = t.part.agg(F.sort_array(F.collect_set("p_brand")).alias("l")).select(F.posexplode("l").alias("position", "p_brand"))
    return listed.where(F.col("p_brand").isin("Brand#7", "Brand#3", "Brand#12")).select("p_brand", "position")
