"""Set operations (T) on the driver tables."""

from pyspark.sql import functions as F

from ..operators import sets
from .registry import query


@query("t01_union_status", "SELECT c_custkey AS k, 'customer' AS status FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def t01(t):
    return sets.union_all({"customer": t.customer.select(F.col("c_custkey").alias("k")), "supplier": t.supplier.select(F.col("s_suppkey").alias("k"))})


@query("t02_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def t02(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("t03_set_difference", "(SELECT doc_id, 'extra' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def t03(t):
    return sets.difference(t.documents, t.labels, "doc_id")


_HALF = "ascii(right(coalesce(source, ''), 1)) % 2"


@query(
    "t04_bank_diff",
    f"""WITH d AS (SELECT sha256(lower(text)) AS key, lang, {_HALF} AS half FROM documents), a AS (SELECT key, min(lang) AS before FROM d WHERE half = 0 GROUP BY 1), b AS (SELECT key, min(lang) AS after FROM d WHERE half <> 0 GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'lost' WHEN a.key IS NULL THEN 'gained' ELSE 'changed' END AS change, before, after FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR before IS DISTINCT FROM after""",
)
def t04(t):
    d, key = t.documents.withColumn("half", F.expr(_HALF)), F.sha2(F.lower("text"), 256)
    return sets.attribute_diff(d.where("half = 0"), d.where("half <> 0"), key, "lang")


@query("t05_disjoint", "SELECT a.s AS a, b.s AS b, (SELECT count(*) FROM documents WHERE (doc_id % 3) || '' = a.s AND (doc_id % 3) || '' = b.s) AS n FROM (VALUES ('0'), ('1'), ('2')) a(s), (VALUES ('0'), ('1'), ('2')) b(s) WHERE a.s < b.s")
def t05(t):
    return sets.overlaps({str(i): t.documents.where(F.col("doc_id") % 3 == i) for i in range(3)}, "doc_id")


@query("t06_set_equality", "SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS is_subset, (SELECT count(DISTINCT doc_id) FROM labels) = (SELECT count(DISTINCT doc_id) FROM documents) AS is_equal")
def t06(t):
    d = sets.difference(t.labels, t.documents, "doc_id")
    return d.agg((F.count_if(F.col("side") == "extra") == 0).alias("is_subset"), (F.count("*") == 0).alias("is_equal"))


@query(
    "t07_jaccard",
    """WITH s AS (SELECT user_id, list_distinct(list(event_type)) AS e, list_distinct(list(CASE WHEN value > 5 THEN event_type END)) AS h FROM events GROUP BY 1)
SELECT user_id, round(len(list_intersect(e, h)) / len(list_distinct(list_concat(e, h))), 6) AS j FROM s""",
)
def t07(t):
    s = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("e"), F.collect_set(F.when(F.col("value") > 5, F.col("event_type"))).alias("h"))
    return s.select("user_id", F.round(sets.jaccard(F.col("e"), F.col("h")), 6).alias("j"))


@query("t08_drop_category", "SELECT count(*) AS concepts, (SELECT count(*) FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE d.lang = 'fr') AS prompts FROM documents WHERE lang = 'fr'")
def t08(t):
    prompts = t.conversations.select(F.col("conv_id").alias("doc_id"), "turn", "text")
    return sets.drop_category(t.documents.select("doc_id", "lang"), prompts, "doc_id", "lang", "fr")[2]


@query(
    "p04_merge_predicate",
    """WITH p AS (SELECT p_partkey, p_name, p_size, p_brand, p_type, list_distinct([p_type, p_brand, split_part(p_name, ' ', 1)]) AS items FROM part),
m AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey
WHERE 1.0 - abs(a.p_size - b.p_size) / 50.0 >= 0.8 AND (NOT (starts_with(a.p_brand, 'Brand#1') AND starts_with(b.p_brand, 'Brand#1')) OR len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items))) >= 0.4))
SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_size, p_brand, p_type) AS class, (SELECT count(*) FROM m WHERE m.a = p.p_partkey) AS n_links FROM p""",
)
def p04(t):
    # Equal parts are one class with a weight: links are found between classes, and copies are never paired.
    content = ["p_name", "p_size", "p_brand", "p_type"]
    # Files of many copies are small for their rows, so sizes of files say too little to broadcast a side.
    c = t.part.groupBy(*content).agg(F.min("p_partkey").alias("class"), F.count("*").alias("n"))
    c = c.withColumn("items", F.array_distinct(F.array("p_type", "p_brand", F.split("p_name", " ")[0])))
    # A similarity of 0.8 is at most 10 sizes apart, so only classes of these sizes meet.
    a = c.withColumn("size", F.explode(F.sequence(F.col("p_size") - 10, F.col("p_size") + 10))).alias("a")
    b = c.withColumn("size", F.col("p_size")).alias("b")
    sim = 1.0 - F.abs(F.col("a.p_size") - F.col("b.p_size")) / 50.0
    ok = sets.may_merge(sim, 0.8, F.col("a.p_brand"), F.col("b.p_brand"), "Brand#1", F.col("a.items"), F.col("b.items"), 0.4)
    met = a.join(b.hint("merge"), (F.col("a.p_name") == F.col("b.p_name")) & (F.col("a.size") == F.col("b.size"))).where(ok)
    links = met.groupBy(F.col("a.class").alias("class")).agg((F.sum("b.n") - 1).alias("n_links"))
    linked = c.select(*content, "class").join(links.hint("merge"), "class")
    return t.part.join(linked.hint("merge"), content).select("p_partkey", "class", "n_links")


@query("p08_label_vocabulary", "SELECT DISTINCT x AS label FROM (SELECT lang AS x FROM documents UNION ALL SELECT c_mktsegment FROM customer) ORDER BY 1")
def p08(t):
    return t.documents.select(F.col("lang").alias("label")).union(t.customer.select("c_mktsegment")).distinct().orderBy("label")
