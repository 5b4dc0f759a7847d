"""Data-quality checks (D) on the driver tables."""

import re

from pyspark.sql import functions as F

from ..functions import stats as st
from ..operators import checks as ck
from .registry import query


@query("d01_duplicates", "SELECT 'duplicate' AS rule, count(*) AS n, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT l_orderkey::VARCHAR AS k FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5)) AS first FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)")
def d01(t):
    return ck.first_named(ck.duplicates(t.lineitem, "l_orderkey"))


@query(
    "d02_referential_integrity",
    """WITH c AS (SELECT CASE WHEN c_custkey % 10 = 3 THEN -c_custkey ELSE c_custkey END AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT 'reference' AS rule, k::VARCHAR AS key, 'extra' AS detail FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT 'reference', k::VARCHAR, 'missing' FROM o WHERE k NOT IN (SELECT k FROM c)""",
)
def d02(t):
    key = F.col("c_custkey")
    return ck.references(t.customer.select(F.when(key % 10 == 3, -key).otherwise(key).alias("k")), "k", t.orders.select(F.col("o_custkey").alias("k")))


@query("d03_attribute_consistency", "SELECT 'inconsistent lang' AS rule, doc_id::VARCHAR AS key, lang || ' / xx' AS detail FROM documents WHERE doc_id % 100 = 3")
def d03(t):
    other = t.documents.select("doc_id", F.when(F.col("doc_id") % 100 == 3, "xx").otherwise(F.col("lang")).alias("lang"))
    return ck.consistent(t.documents, other, "doc_id", "lang")


@query("d04_complete_categories", "SELECT 'categories' AS rule, conv_id::VARCHAR AS key, s AS detail FROM (SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS s FROM conversations GROUP BY 1) WHERE s <> 'assistant,user'")
def d04(t):
    return ck.complete_categories(t.conversations, "conv_id", "role", ["user", "assistant"])


@query("d05_uniform_attribute", "SELECT 'not uniform' AS rule, p_name AS key, count(DISTINCT p_type)::VARCHAR AS detail FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1")
def d05(t):
    return ck.uniform(t.part, "p_name", "p_type")


@query(
    "d06_row_rules",
    "SELECT 'id' AS rule, c_custkey::VARCHAR AS key, '' AS detail FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$') UNION ALL SELECT 'segment', c_custkey::VARCHAR, '' FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE', 'HOUSEHOLD') UNION ALL SELECT 'balance', c_custkey::VARCHAR, '' FROM customer WHERE NOT (c_nationkey <> 2 OR c_acctbal > 0)",
)
def d06(t):
    return ck.row_rules(t.customer, "c_custkey", {
        "id": F.col("c_name").rlike("^Customer#[0-9]*[02468]$"),
        "segment": F.col("c_mktsegment").isin("MACHINERY", "FURNITURE", "HOUSEHOLD"),
        "balance": (F.col("c_nationkey") != 2) | (F.col("c_acctbal") > 0),
    })


@query(
    "d07_row_counts",
    """WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM labels) AS l)
SELECT 'row count' AS rule, 'orders' AS key, o || ' / ' || 6 * c AS detail FROM n WHERE o <> 6 * c UNION ALL SELECT 'row count', 'labels', l || ' / ' || d FROM n WHERE l <> d UNION ALL SELECT 'row count', 'customer', c || ' / ' || c + 1 FROM n""",
)
def d07(t):
    c, d = t.customer.count(), t.documents.count()
    return ck.all_of(ck.row_count(t.orders, "orders", 6 * c), ck.row_count(t.labels, "labels", d), ck.row_count(t.customer, "customer", c + 1), ck.row_count(t.documents, "documents", d))


@query(
    "d08_rank_permutation",
    "SELECT 'permutation' AS rule, l_suppkey::VARCHAR AS key, min(r) || '/' || max(r) || '/' || count(*) || '/' || count(DISTINCT r) || '/' || count(DISTINCT l_partkey) AS detail FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) <> count(*)",
)
def d08(t):
    from ..operators.ranking import by_size, ranked

    rows = by_size(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), ["l_suppkey"])
    return ck.permutation(ranked(rows, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]), "l_suppkey", "rank", "l_partkey")


@query("d09_sum_invariant", "SELECT 'sum' AS rule, l_orderkey::VARCHAR AS key, round(s, 6)::VARCHAR AS detail FROM (SELECT l_orderkey, sum(l_quantity::DOUBLE) AS s FROM lineitem GROUP BY 1) WHERE abs(s - 100) >= 60")
def d09(t):
    return ck.sums_to(t.lineitem.select("l_orderkey", F.col("l_quantity").cast("double").alias("x")), "l_orderkey", "x", 100.0, 60)


@query("d10_range", "SELECT 'range' AS rule, s_suppkey::VARCHAR AS key, s_acctbal::VARCHAR AS detail FROM supplier WHERE s_acctbal NOT BETWEEN 0 AND 9000")
def d10(t):
    return ck.within_range(t.supplier, "s_suppkey", "s_acctbal", 0, 9000)


@query(
    "d11_same_members",
    "WITH s AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, list_sort(list_distinct(list(o_orderpriority))) AS m FROM orders GROUP BY 1) SELECT 'members' AS rule, o_custkey::VARCHAR AS key, n::VARCHAR AS detail FROM s WHERE m <> (SELECT m FROM s ORDER BY o_custkey LIMIT 1)",
)
def d11(t):
    return ck.same_members(t.orders, "o_custkey", "o_orderpriority")


@query("d12_invariant_metadata", "SELECT 'not uniform' AS rule, o_custkey::VARCHAR AS key, count(DISTINCT o_orderstatus || '|' || o_orderpriority)::VARCHAR AS detail FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus || '|' || o_orderpriority) > 1")
def d12(t):
    return ck.uniform(t.orders, "o_custkey", "o_orderstatus", "o_orderpriority")


@query("d13_vector_checks", "SELECT 'unit norm' AS rule, vec_id::VARCHAR AS key, '' AS detail FROM embeddings WHERE abs(sqrt(list_sum(list_transform(CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding::double[], lambda x: x * 2) ELSE embedding::double[] END, lambda x: x * x))) - 1) > 1e-3")
def d13(t):
    v = F.col("embedding").cast("array<double>")
    e = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 50 == 0, F.transform(v, lambda x: x * 2)).otherwise(v).alias("embedding"))
    return ck.vector_checks(e, "vec_id", "embedding", 64)


@query("d15_log_patterns", "SELECT 'bad line' AS rule, line AS key, '' AS detail FROM (SELECT event_id || ' ' || event_type || ' ' || props AS line FROM events) WHERE regexp_matches(line, 'error .*\"k\": 9[0-9]')")
def d15(t):
    lines = t.events.select(F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "props").alias("line"))
    return ck.bad_lines(lines, "line", ['error .*"k": 9[0-9]', "Traceback"])


@query(
    "d16_reported_recomputed",
    """WITH a AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT user_id, event_type, round(v, 1) AS v FROM a WHERE event_type <> 'view')
SELECT count(*) FILTER (abs(a.v - b.v) < 0.02) AS agree, count(*) FILTER (abs(a.v - b.v) >= 0.02) AS differ, count(*) FILTER (b.v IS NULL) AS alone FROM a LEFT JOIN b USING (user_id, event_type)""",
)
def d16(t):
    from ..operators.profiles import reconcile

    sums = st.ordered_sums(t.placed("events"), ["user_id", "event_type"], "place", "value")
    m = sums.select("user_id", "event_type", F.try_divide("sum", "given").alias("v"))
    return reconcile(m, m.where("event_type <> 'view'").withColumn("v", F.round("v", 1)), ["user_id", "event_type"], "v", 0.02)


@query("d17_collected_audit", "SELECT rule, count(*) AS n FROM (SELECT 'duplicate' AS rule FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 UNION ALL SELECT 'range' FROM supplier WHERE s_acctbal NOT BETWEEN 0 AND 9000) GROUP BY 1")
def d17(t):
    return ck.all_of(ck.duplicates(t.lineitem, "l_orderkey"), ck.within_range(t.supplier, "s_suppkey", "s_acctbal", 0, 9000)).groupBy("rule").agg(F.count("*").alias("n"))


@query("p21_all_or_fail", "SELECT 'clean' AS case, 'true' AS outcome UNION ALL SELECT 'broken', min('duplicate: ' || k || ': ' || n) FROM (SELECT l_orderkey::VARCHAR AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1)")
def p21(t):
    clean = ck.fail_on(ck.all_of(ck.duplicates(t.nation, "n_nationkey"), ck.row_count(t.region, "region", 5))).select(F.lit("clean").alias("case"), F.col("valid").cast("string").alias("outcome"))
    try:
        outcome = str(ck.fail_on(ck.all_of(ck.row_count(t.region, "region", 5), ck.duplicates(t.lineitem, "l_orderkey"))).first().valid)
    except Exception as e:  # the error names the first finding
        found = re.search(r"duplicate: \d+: \d+", str(e))
        outcome = found[0] if found else str(e)
    return clean.unionByName(t.spark.createDataFrame([("broken", outcome)], "case string, outcome string"))
