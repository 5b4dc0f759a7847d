"""Projections, filters and rule lists (F) on the driver tables."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rules, sampling
from .registry import query


@query("f01_optional_filter", "SELECT doc_id, lang, source FROM documents WHERE lang = 'fr'")
def f01(t):
    return rules.optional_filter(t.documents, lang="fr", source=None).select("doc_id", "lang", "source")


@query("f02_compound_exclusion", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O')")
def f02(t):
    return t.lineitem.where(~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f03_keyed_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 7")
def f03(t):
    from ..operators.joins import lookup_one

    return lookup_one(t.part, "p_partkey", 7).select("p_partkey", "p_name")


@query("f04_membership_drop", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 3)")
def f04(t):
    return t.nation.where(~F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_name")


@query("f05_substring_reject", "SELECT p_partkey FROM part WHERE NOT (contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'red'))")
def f05(t):
    return t.part.where(~tx.contains_any(F.col("p_name"), ["bolt", "red"])).select("p_partkey")


@query("f06_noise_regex", "SELECT doc_id FROM documents WHERE NOT (regexp_matches(lower(text), '^(?:the|an )') OR (lang = 'en' AND regexp_matches(text, '(?:###)|(?:[A-Z]{9})')))")
def f06(t):
    return t.documents.where(~rules.noise(F.col("text"), ["the", "an "], ["###", "[A-Z]{9}"], F.col("lang") == "en")).select("doc_id")


@query("f07_range_sample", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_mktsegment = 'MACHINERY' ORDER BY md5(c_custkey || ':7'), c_custkey LIMIT 25")
def f07(t):
    inside = t.customer.where(F.col("c_acctbal").between(1000, 5000) & (F.col("c_mktsegment") == "MACHINERY"))
    return sampling.seeded_sample(inside, "c_custkey", 7, 25).select("c_custkey")


_REASONS = """CASE WHEN l.quality = 0 THEN 'low_quality' WHEN l.toxic = 1 THEN 'toxic' WHEN contains(lower(d.text), 'stage i') OR contains(lower(d.text), '***') THEN 'text' WHEN d.n_chars < 200 THEN 'short' END"""


def _reasons(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    rule_list = [
        ("low_quality", F.col("quality") == 0),
        ("toxic", F.col("toxic") == 1),
        ("text", tx.contains_any(F.col("text"), ["stage I", "***"])),
        ("short", F.col("n_chars") < 200),
    ]
    return joined.withColumn("reason", rules.first_reason(rule_list))


@query("f08_first_reason_exclusion", f"SELECT d.doc_id, {_REASONS} AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def f08(t):
    return _reasons(t).select("doc_id", "reason")


@query(
    "f09_inclusion_view",
    f"""WITH r AS (SELECT d.doc_id, d.source, {_REASONS} AS reason, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, source = 'src0' OR matched OR reason IS NULL AS included, CASE WHEN source = 'src0' THEN 'reference' WHEN matched THEN 'matched' WHEN reason IS NULL THEN 'passed' ELSE reason END AS why FROM r""",
)
def f09(t):
    from ..operators.lexicon import inclusion

    matched = t.labels.select("doc_id")
    return inclusion(_reasons(t), "doc_id", F.col("source") == "src0", matched, "reason").select("doc_id", "included", "why")


@query(
    "f10_decision_case",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'no_reference' WHEN l_tax > l_discount THEN 'drop_negative' WHEN l_discount < 0.03 THEN 'drop_far'
WHEN l_discount >= 0.07 AND l_quantity / 50 >= 0.5 THEN 'keep' ELSE 'ambiguous' END AS decision FROM lineitem""",
)
def f10(t):
    d = rules.decide(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.lit(0.07), F.lit(0.03), F.col("l_returnflag") != "N")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", d.alias("decision"))


@query(
    "f11_threshold_precedence",
    """WITH c AS (SELECT l_returnflag, round(avg(l_tax), 6) AS value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(c.value, 0.05) AS threshold, c.value IS NULL AS fallback_used FROM lineitem l LEFT JOIN c USING (l_returnflag)""",
)
def f11(t):
    calibrated = t.lineitem.where("l_returnflag <> 'N'").groupBy("l_returnflag").agg(F.round(F.avg("l_tax"), 6).alias("value"))
    return rules.resolve_thresholds(t.lineitem, "l_returnflag", None, calibrated, 0.05).select("l_orderkey", "l_linenumber", "l_partkey", "threshold", "fallback_used")


@query(
    "f12_rule_classifier",
    """SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'listed' WHEN regexp_matches(p_name, '^blue') THEN 'colour' WHEN regexp_matches(p_name, 'ring$') AND p_size > 30 THEN 'shape' END AS category,
CASE WHEN p_name = 'red widget' THEN 'named' WHEN regexp_matches(p_name, '^blue') THEN 'blue first' WHEN regexp_matches(p_name, 'ring$') AND p_size > 30 THEN 'big ring' END AS reason FROM part""",
)
def f12(t):
    exact = t.spark.createDataFrame([("red widget", "listed", "named")], "name string, category string, reason string")
    out = rules.classify(t.part, "p_name", exact, [("^blue", "colour", "blue first")], [("ring$", "shape", "big ring")], F.col("p_size") > 30)
    return out.select("p_partkey", "category", "reason")


@query("f13_rule_names_exist", "SELECT n AS p_name FROM (VALUES ('red widget'), ('no such part')) v(n) WHERE n NOT IN (SELECT p_name FROM part)")
def f13(t):
    listed = t.spark.createDataFrame([("red widget",), ("no such part",)], "p_name string")
    return rules.missing_names(listed, t.part, "p_name")


@query("f14_guarded_drop", "SELECT p_partkey FROM part WHERE NOT ((p_partkey = 1 AND p_name = 'red widget') OR (p_partkey = 2 AND p_name = 'something else') OR p_name = 'blue bolt')")
def f14(t):
    guards = t.spark.createDataFrame([(1, "red widget"), (2, "something else"), (None, "blue bolt")], "g_id long, g_name string")
    hit = (F.col("p_name") == F.col("g_name")) & F.coalesce(F.col("p_partkey") == F.col("g_id"), F.lit(True))
    return t.part.join(guards, hit, "left_anti").select("p_partkey")


@query(
    "f15_pattern_groups",
    """SELECT doc_id, regexp_extract(text, '(\\*\\*\\*|###)', 1) AS junk, regexp_extract(text, '([0-9]{3,})', 1) AS digits FROM documents WHERE regexp_matches(text, '\\*\\*\\*|###') OR regexp_matches(text, '[0-9]{3,}')""",
)
def f15(t):
    hits = {"junk": r"(\*\*\*|###)", "digits": r"([0-9]{3,})"}
    out = t.documents.select("doc_id", *[F.regexp_extract("text", p, 1).alias(k) for k, p in hits.items()])
    return out.where("junk <> '' OR digits <> ''")


@query("f16_fixed_projection", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def f16(t):
    from ..operators.checks import to_schema

    return to_schema(t.supplier, "s_suppkey bigint, s_name string, s_nationkey int")


@query("f17_prefix_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def f17(t):
    return t.orders.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


@query("f18_weak_prompts", "SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN 'long' ELSE 'blank' END AS why FROM conversations WHERE length(text) > 300 OR trim(text) = role")
def f18(t):
    why = F.when(F.length("text") > 300, "long").otherwise("blank")
    return t.conversations.where((F.length("text") > 300) | (F.trim("text") == F.col("role"))).select("conv_id", "turn", why.alias("why"))
