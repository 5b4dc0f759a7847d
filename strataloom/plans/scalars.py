"""Scalar functions (X, P) on the driver tables."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import sets
from .registry import query

_EMB = "embedding::double[]"
_NORM = f"sqrt(list_sum(list_transform({_EMB}, lambda x: x * x)))"


@query("x01_normalize_name", "SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS name_sha FROM documents")
def x01(t):
    return t.documents.select("doc_id", F.sha2(tx.normalize_name(F.col("text")), 256).alias("name_sha"))


_STOP = ["the", "a", "an", "of", "and", "is", "in"]


@query(
    "x02_normalize_entity",
    """WITH s AS (SELECT p_partkey, lower(regexp_replace(regexp_replace('The ' || p_name || ' ' || p_size || '. ', '^[\\s[:punct:]]+', ''), '[\\s[:punct:]]+$', '')) AS s FROM part),
a AS (SELECT p_partkey, CASE WHEN starts_with(s, 'the ') THEN s[5:] ELSE s END AS s FROM s)
SELECT p_partkey, CASE WHEN length(s) >= 3 AND NOT regexp_matches(s, '^[0-9.,]+$') THEN regexp_replace(s, '\\s+', ' ', 'g') END AS entity FROM a""",
)
def x02(t):
    raw = F.concat(F.lit("The "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(". "))
    return t.part.select("p_partkey", tx.normalize_entity(raw, _STOP).alias("entity"))


@query(
    "x03_clean_synonyms",
    """WITH s AS (SELECT p_partkey, p_name, [upper(p_name), ' ' || p_type || ' ', p_brand, '', lower(p_type), p_brand || ' ' || p_type] AS a FROM part),
u AS (SELECT p_partkey, p_name, i, trim(a[i]) AS x FROM s, unnest(range(1, 7)) AS t(i)),
k AS (SELECT p_partkey, x, row_number() OVER (PARTITION BY p_partkey, lower(x) ORDER BY i) AS r FROM u WHERE x <> '' AND lower(x) <> lower(p_name))
SELECT p_partkey, string_agg(x, '|' ORDER BY lower(x), x) AS synonyms FROM k WHERE r = 1 GROUP BY p_partkey""",
)
def x03(t):
    items = F.array(
        F.upper("p_name"), F.concat(F.lit(" "), "p_type", F.lit(" ")), F.col("p_brand"), F.lit(""), F.lower("p_type"), F.concat_ws(" ", "p_brand", "p_type")
    )
    return t.part.select("p_partkey", F.array_join(tx.clean_synonyms(items, F.col("p_name")), "|").alias("synonyms"))


@query(
    "x04_capped_synonyms",
    """WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))) AS x FROM documents),
l AS (SELECT doc_id, min(x) AS x, lower(x) AS k FROM w WHERE regexp_matches(x, '^[a-z]+$') GROUP BY doc_id, lower(x)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, x) AS n FROM l)
SELECT doc_id, string_agg(x, '|' ORDER BY k, x) AS synonyms FROM r WHERE n <= 20 GROUP BY doc_id""",
)
def x04(t):
    # Only lower-case words here, so the quadratic first-spelling scan is not needed.
    words = F.filter(F.array_distinct(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")), lambda x: x.rlike("^[a-z]+$"))
    out = t.documents.select("doc_id", F.slice(tx.sort_by_lower(words), 1, 20).alias("s"))
    return out.where(F.size("s") > 0).select("doc_id", F.array_join("s", "|").alias("synonyms"))


@query(
    "x05_truncate_sentence",
    """SELECT doc_id, CASE WHEN length(text) <= 120 THEN text
  WHEN regexp_extract(text[1:120], '(?s)^(.+\\.) ', 1) <> '' THEN regexp_extract(text[1:120], '(?s)^(.+\\.) ', 1) ELSE text[1:120] END AS definition FROM documents""",
)
def x05(t):
    return t.documents.select("doc_id", tx.truncate_sentence(F.col("text"), 120).alias("definition"))


@query("x06_humanize", "SELECT c_custkey, upper(s[1]) || lower(s[2:]) AS label FROM (SELECT c_custkey, replace(c_mktsegment || ' no_' || c_nationkey, '_', ' ') AS s FROM customer)")
def x06(t):
    raw = F.concat(F.lit("SET_"), F.col("c_mktsegment"), F.lit(" no_"), F.col("c_nationkey").cast("string"))
    return t.customer.select("c_custkey", tx.humanize(raw).alias("label"))


@query(
    "x07_sentence_case",
    """WITH w AS (SELECT p_partkey, string_split(p_type || ' ' || upper(p_name), ' ') AS w FROM part),
s AS (SELECT p_partkey, array_to_string(list_transform(w, lambda x: CASE WHEN upper(x) IN ('PROMO', 'RING') THEN upper(x) ELSE lower(x) END), ' ') AS s FROM w)
SELECT p_partkey, upper(s[1]) || s[2:] AS label FROM s""",
)
def x07(t):
    return t.part.select("p_partkey", tx.sentence_case(F.concat_ws(" ", "p_type", F.upper("p_name")), ["PROMO", "RING"]).alias("label"))


@query(
    "x08_parse_list",
    """WITH u AS (SELECT event_id, i, upper(trim(string_split(event_type || ', ' || lower(event_type) || ' ,k' || user_id % 7 || ',,', ',')[i])) AS x FROM events, unnest(range(1, 6)) AS t(i)),
d AS (SELECT event_id, x, min(i) AS i FROM u WHERE x <> '' GROUP BY event_id, x)
SELECT event_id, string_agg(x, '|' ORDER BY i) AS items FROM d GROUP BY event_id""",
)
def x08(t):
    raw = F.concat("event_type", F.lit(", "), F.lower("event_type"), F.lit(" ,k"), (F.col("user_id") % 7).cast("string"), F.lit(",,"))
    extra = F.create_map(F.lit("genes"), raw)
    return t.events.select("event_id", F.array_join(tx.parse_list(F.element_at(extra, "genes")), "|").alias("items"))


@query("x09_first_items", "SELECT doc_id, array_to_string(list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:5], lambda x: CASE WHEN regexp_matches(x, '^[a-z]') THEN upper(x[1]) ELSE x[1] END || lower(x[2:])), ', ') AS head FROM documents")
def x09(t):
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return t.documents.select("doc_id", tx.first_items(words, 5, restyle=True).alias("head"))


@query("x10_id_number", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1)::BIGINT AS n FROM customer")
def x10(t):
    return t.customer.select("c_custkey", tx.id_number(F.col("c_name")).alias("n"))


@query("x11_category_map", "SELECT doc_id, CASE lang WHEN 'en' THEN 'germanic' WHEN 'de' THEN 'germanic' WHEN 'fr' THEN 'romance' WHEN 'es' THEN 'romance' END AS family FROM documents")
def x11(t):
    families = {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"}
    return t.documents.select("doc_id", tx.map_or_fail(F.col("lang"), families).alias("family"))


_LEVELS = [("tissue", ["widget", "gear"]), ("cell", ["bolt", "ring"]), ("organ", ["large", "medium"])]


@query(
    "x12_keyword_level",
    """SELECT p_partkey, CASE WHEN regexp_matches(s, '(^|\\s)(widget|gear)(\\s|$)') THEN 'tissue' WHEN regexp_matches(s, '(^|\\s)(bolt|ring)(\\s|$)') THEN 'cell'
WHEN regexp_matches(s, '(^|\\s)(large|medium)(\\s|$)') THEN 'organ' ELSE 'other' END AS level FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS s FROM part)""",
)
def x12(t):
    return t.part.select("p_partkey", tx.keyword_level(F.concat_ws(" ", "p_name", "p_type"), _LEVELS, "other").alias("level"))


@query(
    "x13_substring_category",
    """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ed w') OR contains(lower(p_name), 'ue') THEN 'colour' WHEN contains(lower(p_name), 'in') THEN 'in'
ELSE CASE WHEN p_size > 25 THEN 'big' ELSE 'unknown' END END AS category FROM part""",
)
def x13(t):
    fallback = F.when(F.col("p_size") > 25, "big").otherwise("unknown")
    return t.part.select("p_partkey", tx.substring_category(F.col("p_name"), [("colour", ["ed w", "ue"]), ("in", ["in"])], fallback).alias("category"))


@query(
    "x14_alias_normaliser",
    """WITH al(alias, organ) AS (VALUES ('red', 'r'), ('red widget', 'rw'), ('bolt', 'b'), ('blue bolt', 'bb'), ('ring', 'g')),
hit AS (SELECT p_partkey, organ, row_number() OVER (PARTITION BY p_partkey ORDER BY (p_name = alias) DESC, length(alias) DESC, alias) AS r
  FROM part JOIN al ON contains(' ' || p_name || ' ', ' ' || alias || ' '))
SELECT p.p_partkey, coalesce(h.organ, 'none') AS organ FROM part p LEFT JOIN hit h ON p.p_partkey = h.p_partkey AND r = 1""",
)
def x14(t):
    from ..operators.rules import alias_normalize

    aliases = t.spark.createDataFrame([("red", "r"), ("red widget", "rw"), ("bolt", "b"), ("blue bolt", "bb"), ("ring", "g")], "alias string, value string")
    return alias_normalize(t.part, "p_partkey", "p_name", aliases, "none").select("p_partkey", F.col("value").alias("organ"))


@query("x15_template_fill", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'a large ' || p_name || ' by ' || p_brand ELSE p_name || ' (' || p_type || ')' END AS prompt FROM part")
def x15(t):
    template = F.when(F.col("p_size") > 25, "a large {name} by {brand}").otherwise("{name} ({type})")
    return t.part.select("p_partkey", tx.fill(template, name=F.col("p_name"), brand=F.col("p_brand"), type=F.col("p_type")).alias("prompt"))


@query("x16_keyword_flag", "SELECT doc_id, contains(lower(text), 'idiot') OR contains(lower(text), 'scum') AS flagged FROM documents")
def x16(t):
    return t.documents.select("doc_id", tx.contains_any(F.col("text"), ["idiot", "Scum"]).alias("flagged"))


@query(
    "x17_discordance",
    """SELECT l_orderkey, l_linenumber, CASE WHEN least(l_returnflag, l_linestatus) = 'A' AND greatest(l_returnflag, l_linestatus) = 'F' THEN 'near'
WHEN least(l_returnflag, l_linestatus) = 'O' AND greatest(l_returnflag, l_linestatus) = 'R' THEN 'far' ELSE 'other' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def x17(t):
    kind = tx.unordered_class(F.col("l_returnflag"), F.col("l_linestatus"), {("F", "A"): "near", ("R", "O"): "far"}, "other")
    return t.lineitem.groupBy("l_orderkey", "l_linenumber", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("x18_map_hash", "SELECT event_id, sha256('type=' || event_type || '&user=' || user_id) AS h FROM events")
def x18(t):
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("apikey"), F.lit("secret"), F.lit("type"), F.col("event_type"))
    return t.events.select("event_id", tx.hash_of_map(m, ["apikey"]).alias("h"))


@query(
    "x19_keyed_seed",
    """SELECT n_nationkey, (list_sum(list_transform(range(0, 8), lambda i: ('0x' || sha256('41001|' || n_name)[i * 2 + 1:i * 2 + 2])::HUGEINT * (256::HUGEINT ** i)::HUGEINT))::HUGEINT % 9223372036854775807)::BIGINT AS seed FROM nation""",
)
def x19(t):
    return t.nation.select("n_nationkey", tx.seed_of(41001, F.col("n_name")).alias("seed"))


@query("x20_decode_barcode", "SELECT c_custkey, c_name AS barcode FROM customer")
def x20(t):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("b'"), "c_name", F.lit("'"))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", tx.decode_barcode(raw).alias("barcode"))


@query("x21_log1p", "SELECT event_id, round(ln(1 + value), 9) AS v FROM events")
def x21(t):
    return t.events.select("event_id", F.round(F.log1p("value"), 9).alias("v"))


_LOGITS = "[l_quantity / 10, l_discount * 20, l_tax * 30, l_linenumber / 2.0]"


@query(
    "x22_softmax",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, {_LOGITS} AS v FROM lineitem),
e AS (SELECT *, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, round(e[1] / list_sum(e), 8) AS p1, round(e[4] / list_sum(e), 8) AS p4 FROM e""",
)
def x22(t):
    v = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 20, F.col("l_tax") * 30, F.col("l_linenumber") / 2.0)
    p = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", vx.softmax(v).alias("p"))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("p")[0], 8).alias("p1"), F.round(F.col("p")[3], 8).alias("p4"))


@query("x23_unit_vectors", f"SELECT vec_id, round(({_EMB})[1] / {_NORM}, 8) AS first, round(({_EMB})[64] / {_NORM}, 8) AS last FROM embeddings")
def x23(t):
    u = t.embeddings.select("vec_id", vx.normalize(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.col("u")[0], 8).alias("first"), F.round(F.col("u")[63], 8).alias("last"))


@query("x24_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x24(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


@query(
    "x25_max_similarity",
    """WITH c AS (SELECT vec_id AS c, embedding::double[] AS e FROM embeddings WHERE vec_id < 4),
s AS (SELECT v.vec_id, c.c, round(list_cosine_similarity(v.embedding::double[], c.e), 6) AS s FROM embeddings v, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS r FROM s)
SELECT vec_id, c AS best, s AS sim FROM r WHERE r = 1""",
)
def x25(t):
    from ..operators.joins import max_similarity

    named = t.embeddings.where("vec_id < 4").select(F.col("vec_id").alias("name"), F.col("embedding").alias("centroid"))
    return max_similarity(t.embeddings.select("vec_id", "embedding"), named, "embedding", 6).select("vec_id", F.col("name").cast("long").alias("best"), "sim")


@query(
    "x26_two_view_embedding",
    f"""WITH a AS (SELECT vec_id, list_transform({_EMB}, lambda x: x / {_NORM}) AS u FROM embeddings),
s AS (SELECT a.vec_id, list_transform(range(1, 65), lambda i: a.u[i] + b.u[i]) AS s FROM a JOIN a b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(s[1] / sqrt(list_sum(list_transform(s, lambda x: x * x))), 8) AS first FROM s""",
)
def x26(t):
    u = t.embeddings.select("vec_id", vx.normalize(F.col("embedding")).alias("u"))
    b = u.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("w"))
    return u.join(b, "vec_id").select("vec_id", F.round(vx.two_view(F.col("u"), F.col("w"))[0], 8).alias("first"))


@query("x27_one_hot", "SELECT doc_id, (lang = 'de')::INT::DOUBLE AS de, (lang = 'en')::INT::DOUBLE AS en, (lang = 'fr')::INT::DOUBLE AS fr FROM documents")
def x27(t):
    v = t.documents.select("doc_id", vx.one_hot(F.col("lang"), ["de", "en", "fr"]).alias("v"))
    return v.select("doc_id", *[F.col("v")[i].alias(k) for i, k in enumerate(("de", "en", "fr"))])


@query("x28_prefix_technology", "SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'one' ELSE 'rest' END AS technology FROM part")
def x28(t):
    return t.part.select("p_partkey", F.when(F.col("p_brand").startswith("Brand#1"), "one").otherwise("rest").alias("technology"))


@query("x29_pair_type", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, CASE WHEN a.s_nationkey = b.s_nationkey THEN 'same' ELSE 'cross' END AS pair_type FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def x29(t):
    b = t.supplier.select(F.col("s_suppkey").alias("b"), (F.col("s_suppkey") - 1).alias("a"), F.col("s_nationkey").alias("n"))
    a = t.supplier.select(F.col("s_suppkey").alias("a"), "s_nationkey")
    return a.join(b, "a").select("a", "b", F.when(F.col("s_nationkey") == F.col("n"), "same").otherwise("cross").alias("pair_type"))


@query("x30_legacy_remap", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS status FROM orders")
def x30(t):
    legacy = F.create_map(*map(F.lit, ("P", "pending", "F", "done")))
    return t.orders.select("o_orderkey", F.coalesce(F.element_at(legacy, F.col("o_orderstatus")), "o_orderstatus").alias("status"))


@query("x31_finite_or_null", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events")
def x31(t):
    odd = F.when(F.col("event_id") % 3 == 0, F.col("value")).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    return t.events.select("event_id", tx.finite(odd).alias("v"))


@query("x32_nested_default", "SELECT event_id, coalesce((props->>'$.k')::INT, -1) AS k, 'none' AS other FROM events")
def x32(t):
    c = F.from_json("props", "struct<k:int,x:struct<y:string>>")
    return t.events.select("event_id", F.coalesce(c.k, F.lit(-1)).alias("k"), F.coalesce(c.x.y, F.lit("none")).alias("other"))


@query("x33_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 30 THEN text[1:29] || '…' ELSE text END AS name FROM documents")
def x33(t):
    return t.documents.select("doc_id", tx.ellipsis(F.col("text"), 30).alias("name"))


@query(
    "x34_plural_pairs",
    """WITH n AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(regexp_replace(text, '[^\\p{L}]+', ' ', 'g')), ' ')) AS w FROM documents) WHERE w <> '')
SELECT a.w AS singular, b.w AS plural FROM n a JOIN n b ON b.w = a.w || 's'""",
)
def x34(t):
    words = t.documents.select(F.explode(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}]+", " ")), " ")).alias("w")).where("w <> ''")
    return sets.ending_pairs(words, "w").select("singular", "plural")


@query("x35_guided_step", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity + 0.5 * (l_tax + 1.5 * (l_discount - l_tax)), 8) AS x FROM lineitem")
def x35(t):
    step = vx.guided_step(F.array("l_quantity"), F.array("l_discount"), F.array("l_tax"), 1.5, 0.5)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(step[0], 8).alias("x"))


@query("p05_source_priority", "SELECT doc_id, CASE source WHEN 'src3' THEN 1 WHEN 'src0' THEN 2 WHEN 'src7' THEN 3 ELSE 4 END AS rank FROM documents")
def p05(t):
    return t.documents.select("doc_id", tx.priority_rank(F.col("source"), ["src3", "src0", "src7"]).alias("rank"))


@query("p18_redact_parameter", "SELECT page_id, regexp_replace(url, '([?&]ref=)[^&#]*', '\\1***') AS url FROM pages")
def p18(t):
    links = t.pages.select("page_id", F.transform_values(F.create_map(F.lit("self"), F.col("url")), lambda k, v: tx.redact(v, "ref")).alias("m"))
    return links.select("page_id", F.element_at("m", "self").alias("url"))


@query("p24_prompt_block", "SELECT doc_id, 'id: ' || doc_id || chr(10) || 'source: ' || source || chr(10) || 'text: ' || text[1:200] AS block FROM documents")
def p24(t):
    return t.documents.select("doc_id", tx.prompt_block({c if c != "doc_id" else "id": F.col(c) for c in ("doc_id", "source", "text")}, {"text": 200}).alias("block"))
