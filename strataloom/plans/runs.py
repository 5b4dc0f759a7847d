"""Remote sources by replayed replies, run drivers, parsers and records (S, C, D, P)."""

from __future__ import annotations

import json
from urllib.parse import urlencode

from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import vectors as vx
from ..operators import cluster, density, lexicon, resolve
from ..sources import bank, cache, files, markup, paged, remote, runs
from ..storage import fresh_path
from .registry import query
from .stages import ViewConfig


@query(
    "s08_ordered_csv",
    "SELECT 'c_name,c_custkey' AS line, 1 AS n UNION ALL SELECT c_name || ',' || c_custkey, count(*) FROM customer GROUP BY ALL",
)
def s08(t):
    files.write_csv(t.customer.coalesce(1), path := fresh_path(t.spark, "csv"), ["c_name", "c_custkey"])
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("s11_vectors_with_ids", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, vec_id AS id, len(embedding) AS d, round(embedding[1]::DOUBLE + 2 * embedding[64]::DOUBLE, 6) AS ends FROM embeddings")
def s11(t):
    files.write_with_sidecar(t.embeddings.select("vec_id", "embedding"), path := fresh_path(t.spark, "vectors"), "embedding")
    v = files.read_vectors(t.spark, path, "vec_id", "embedding")
    first, last = (F.element_at("vector", i).cast("double") for i in (1, 64))
    return v.select("position", "id", F.size("vector").alias("d"), F.round(first + 2 * last, 6).alias("ends"))


def ontology_replies(path: str, params) -> tuple[int, str]:
    """Class pages of three: region r has 2 r + 1 children, linked by nextPage or by page numbers."""
    r, page = int(path.split("/")[2]), int(params.get("page", "1"))
    n, pages = 2 * r + 1, -(-(2 * r + 1) // 3)
    items = [{"@id": f"http://x/{r}/{i}", "prefLabel": f"class {r} {i}"} for i in range(3 * (page - 1), min(3 * page, n))]
    link = f"https://api.example{path}?{urlencode({'page': page + 1, 'size': 3})}" if r % 2 == 0 and page < pages else None
    return 200, json.dumps({"page": page, "pageCount": pages if r % 2 else 1, "links": {"nextPage": link}, "collection": items})


@query(
    "s17_paged_scan",
    "SELECT r_regionkey::VARCHAR AS root, (i // 3 + 1)::INT AS page, 'http://x/' || r_regionkey || '/' || i AS source_id, 'class ' || r_regionkey || ' ' || i AS preferred_label FROM region, unnest(range(0, 2 * r_regionkey + 1)) AS t(i)",
)
def s17(t):
    paged.register(t.spark)
    roots = [[str(r.r_regionkey), f"/classes/{r.r_regionkey}/children", {}] for r in t.region.select("r_regionkey").collect()]  # a root is a request's name
    pages = t.spark.read.format(paged.NAME).options(roots=json.dumps(roots), fetcher=f"{__name__}:ontology_replies", rate="1000", burst="8").load()
    item = F.from_json("item", "struct<`@id`:string,prefLabel:string>")
    return pages.select("root", "page", item["@id"].alias("source_id"), item.prefLabel.alias("preferred_label"))


def article_replies(path: str, params) -> tuple[int, str]:
    """A set of articles for ids, or for a range of a stored search."""
    ids = params["id"].split(",") if "id" in params else [f"h{i}" for i in range(int(params["retstart"]), int(params["retstart"]) + int(params["retmax"]))]
    one = "<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>title {0}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    return 200, "<PubmedArticleSet>" + "".join(map(one.format, ids)) + "</PubmedArticleSet>"


@query(
    "s18_batched_fetch",
    "SELECT p_partkey::VARCHAR AS pmid, 'title ' || p_partkey AS title FROM part UNION ALL SELECT 'h' || i, 'title h' || i FROM (SELECT count(*) AS n FROM nation), unnest(range(0, n)) AS t(i)",
)
def s18(t):
    by_id = remote.id_batches(t.part, "p_partkey", 50, "/fetch", {"db": "articles"})
    replies = cache.ResponseCache(fresh_path(t.spark, "replies"), ["api_key"]).through(by_id, article_replies, rate=1000.0, burst=8)
    paged.register(t.spark)
    options = {"path": "/fetch", "params": json.dumps({"db": "articles", "WebEnv": "w"}), "total": str(t.nation.count()), "size": "10", "batches": "2"}
    by_history = t.spark.read.format(paged.NAME).options(fetcher=f"{__name__}:article_replies", **options).load()
    bodies = replies.select("body").unionByName(by_history.select(F.col("item").alias("body")))
    each = bodies.select(F.explode(F.regexp_extract_all("body", F.lit("(?s)(<PubmedArticle>.*?</PubmedArticle>)"), F.lit(1))).alias("xml"))
    return markup.articles(each, "xml", []).select("pmid", "title")


def page_replies(path: str, params) -> tuple[int, str]:
    """The path again; an error for every seventh page."""
    return (503, "") if int(params["page"]) % 7 == 0 else (200, f"{path}?page={params['page']}")


def no_replies(path: str, params) -> tuple[int, str]:
    raise OSError("nothing should be asked")


@query(
    "s20b_read_through",
    """WITH p AS (SELECT page_id, split_part(url, '?', 1) AS u FROM pages)
SELECT page_id, sha256(u || '?page=' || page_id % 50) AS key, CASE WHEN page_id % 50 % 7 <> 0 THEN u || '?page=' || page_id % 50 END AS body, false AS asked FROM p""",
)
def s20b(t):
    page = F.create_map(F.lit("page"), (F.col("page_id") % 50).cast("string"), F.lit("api_key"), F.col("page_id").cast("string"))
    requests = t.pages.select("page_id", F.split("url", r"\?")[0].alias("path"), page.alias("params"))
    replies = cache.ResponseCache(fresh_path(t.spark, "replies"), ["api_key"])
    replies.through(requests, page_replies, attempts=1)
    # Errors are not kept; what is kept is not asked again, here or after the runs are put together.
    known = requests.where("page_id % 50 % 7 <> 0")
    replies.compact(t.spark)
    second = replies.through(known, no_replies).select("page_id", "key", "body", "asked")
    rest = requests.where("page_id % 50 % 7 = 0").select("page_id", replies.key(F.col("path"), F.col("params")).alias("key"))
    return second.unionByName(rest.join(replies.entries(t.spark).select("key", "body"), "key", "left").select("page_id", "key", "body", F.lit(False).alias("asked")))


#: Status, body, kind of error and whether asking again may help.
_REPLIES = [
    (200, "ok", None, False), (401, "", "authentication", False), (403, "Licensed content", "licence", False), (403, "denied", "authentication", False), (404, "", "not_found", False),
    (429, "", "rate_limited", True), (503, "", "transient", True), (200, "<ERROR>API key invalid</ERROR>", "authentication", False), (200, "<ERROR>Rate limit exceeded</ERROR>", "rate_limited", False),
    (200, "<ERROR>other</ERROR>", "malformed", False), (200, "<r><ERROR>Invalid key given</ERROR></r>", "authentication", False), (200, "<ERROR>apikey?</ERROR>", "authentication", False),
    (403, "see the Terms of Use", "licence", False), (403, "needs an agreement", "licence", False), (403, "Subscribe first", "licence", False), (200, "<ERROR>too many requests</ERROR>", "rate_limited", False),
    (200, "<ERROR>api key", "malformed", False), (500, "<ERROR>api key</ERROR>", "transient", True), (200, "unauthorized api key in a text", None, False), (418, "", "transient", False),
]


def _texts(column: int) -> str:
    return "[" + ", ".join("NULL" if r[column] is None else f"'{r[column]}'" for r in _REPLIES) + f"][event_id % {len(_REPLIES)} + 1]"


@query("p17_reply_errors", f"SELECT event_id, {_texts(2)} AS error, {_texts(3)}::BOOLEAN AS again FROM events")
def p17(t):
    at = (F.col("event_id") % len(_REPLIES)).cast("int")
    status, body = (F.get(F.array(*[F.lit(r[i]) for r in _REPLIES]), at) for i in (0, 1))
    r = t.events.select("event_id", status.alias("status"), body.alias("body"))
    return r.select("event_id", remote.reply_error(F.col("status"), F.col("body")).alias("error"), remote.retryable(F.col("status")).alias("again"))


@query(
    "p15_run_sources",
    "SELECT 'row' AS kind, 'a' AS source, n_name AS detail FROM nation UNION ALL SELECT 'row', 'd', r_name FROM region UNION ALL SELECT 'failure', 'b', 'PermissionError' UNION ALL SELECT 'failure', 'late', 'failed'",
)
def p15(t):
    def refused():
        raise PermissionError("no licence")

    def late():  # fails when rows are made
        return t.nation.select(F.lit("late").alias("source_name"), F.when(F.col("n_nationkey") == 7, F.raise_error(F.lit("bad row")).cast("string")).otherwise(F.col("n_name")).alias("label"))

    sources = [
        ("a", True, lambda: t.nation.select(F.lit("a").alias("source_name"), F.col("n_name").alias("label"))), ("b", True, refused), ("late", True, late),
        ("off", False, refused), ("d", True, lambda: t.region.select(F.lit("d").alias("source_name"), F.col("r_name").alias("label"))),
    ]
    rows, failures = runs.run_sources(t.spark, sources, "source_name string, label string")
    named = F.when(F.col("source") == "late", "failed").otherwise(F.col("error"))
    return rows.select(F.lit("row").alias("kind"), F.col("source_name").alias("source"), F.col("label").alias("detail")).unionByName(failures.select(F.lit("failure").alias("kind"), "source", named.alias("detail")))


@query(
    "p11_term_lists",
    "SELECT 'anatomy' AS class, n_name AS term FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 20) UNION ALL SELECT 'disease', r_name FROM region UNION ALL SELECT 'cached', 'kept'",
)
def p11(t):
    def licence():
        raise runs.LicenceRefused("needs a licence")

    def broken():
        raise OSError("down")

    def nations():
        return t.nation.select(F.col("n_name").alias("term"))

    def regions():
        return t.region.select(F.col("r_name").alias("term"))

    cache = fresh_path(t.spark, "terms")
    t.spark.createDataFrame([("kept",)], "term string").write.parquet(f"{cache}/cached")
    # A refusal asks the next source; any other failure leaves the class empty.
    classes = {"anatomy": [nations], "disease": [licence, regions], "procedure": [broken, regions], "cached": [broken], "none": [licence]}
    runs.term_lists(t.spark, classes, cache, 20)
    return runs.term_lists(t.spark, {**classes, "anatomy": [broken], "disease": [broken]}, cache, 20)


@query(
    "p13_calibration_reuse",
    """WITH u AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings), m AS (SELECT label, i, avg(v[i]) AS x FROM u, unnest(range(1, 65)) AS t(i) GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1), neg AS (SELECT label AS name, c AS v FROM c WHERE label < 2),
own AS (SELECT u.label, list_cosine_similarity(u.v, c.c) AS score, (SELECT max(list_cosine_similarity(u.v, neg.v)) FROM neg) AS negative FROM u JOIN c USING (label)),
p AS (SELECT label, quantile_cont(score, 0.25) AS k, avg(negative) AS d FROM own GROUP BY 1)
SELECT label, round(CASE WHEN k < d + 0.01 THEN 0.55 ELSE k END, 5) AS keep, round(CASE WHEN k < d + 0.01 THEN 0.35 ELSE d END, 5) AS "drop", 1 AS built FROM p""",
)
def p13(t):
    built, e = [], t.embeddings

    def build():
        built.append(1)
        return vx.centroid(e.where("label < 2"), "label", "embedding").select(F.col("label").alias("name"), "centroid")

    path = fresh_path(t.spark, "centroids")
    for _ in range(2):  # the second run reads what the first one stored
        centroids = runs.reuse(t.spark, path, build, "name int, centroid array<double>")
        out = resolve.calibrate(e, "vec_id", "embedding", "label", centroids, 0.25, 0.01, 0.55, 0.35)
    return out.select("label", F.round("keep", 5).alias("keep"), F.round("drop", 5).alias("drop"), F.lit(len(built)).alias("built"))


@query("p14_gene_set_harvest", "SELECT 'x.gmt:' || p_brand AS source_id, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS genes, 'tx' AS tier FROM part GROUP BY p_brand UNION ALL SELECT 'y.gmt:S', 'A,B', 'ty'")
def p14(t):
    folder = fresh_path(t.spark, "gmt")
    sets = t.part.groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_set("p_name")).alias("members"))
    files.write_gene_sets(sets.select("name", F.lit("http://x.example").alias("url"), "members"), f"{folder}/x.gmt")
    asked = []

    def download(name, path):
        asked.append(name)
        files.write_text(t.spark, path, "S\thttp://y.example\tA\tB\nempty\thttp://y.example\n")

    found = runs.harvest_gene_sets(t.spark, folder, {"x.gmt": "tx", "y.gmt": "ty"}, download)
    if asked != ["y.gmt"]:
        raise ValueError(f"asked for {asked}")
    return found.select("source_id", F.element_at("extra", "genes").alias("genes"), F.col("candidate_tier").alias("tier"))


@query(
    "p14b_mention_harvest",
    """WITH t AS (SELECT p_partkey AS doc, p_brand AS q, string_split(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE upper(p_name[1]) || p_name[2:] END, ' ') AS ws FROM part),
o AS (SELECT doc, q, i, array_to_string(ws[i:i + n - 1], ' ') AS form FROM t, unnest(range(1, len(ws) + 1)) AS a(i), unnest([1, 2]) AS b(n) WHERE i + n - 1 <= len(ws)),
m AS (SELECT *, lower(form) AS f FROM o WHERE lower(form) IN (SELECT p_name FROM part WHERE p_size < 5 UNION ALL SELECT split_part(p_name, ' ', 1) FROM part WHERE p_size = 7)),
c AS (SELECT f, form, count(*) AS n, min((doc, i)) AS first FROM m GROUP BY ALL), l AS (SELECT f, arg_min(form, (-n, length(form), first)) AS label FROM c GROUP BY 1),
s AS (SELECT c.f, string_agg(c.form, '|' ORDER BY c.first) AS synonyms FROM c JOIN l USING (f) WHERE c.form <> l.label GROUP BY 1)
SELECT 'kind' AS tier, label, coalesce(any_value(synonyms), '') AS synonyms, count(*) AS n, string_agg(DISTINCT q, ',' ORDER BY q) AS queries FROM m JOIN l USING (f) LEFT JOIN s USING (f) GROUP BY f, label HAVING count(*) >= 2""",
)
def p14b(t):
    case = F.col("p_partkey") % 3
    capital = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000))
    texts = t.part.select(F.col("p_partkey").alias("doc"), F.when(case == 0, F.col("p_name")).when(case == 1, F.upper("p_name")).otherwise(capital).alias("text"), F.col("p_brand").alias("query"))
    # Names of one or two words in every spelling that the texts have.
    known = t.part.where("p_size < 5").select(F.col("p_name").alias("w")).unionByName(t.part.where("p_size = 7").select(F.substring_index("p_name", " ", 1).alias("w"))).distinct()
    words = F.split("text", " ")
    forms = texts.select(F.explode(F.array_union(words, F.array("text"))).alias("form")).distinct().join(known, F.lower("form") == F.col("w"))
    terms = forms.select("form", F.lit("KIND").alias("label"), F.lit(None).cast("string").alias("expansion"))
    found = runs.harvest_mentions(texts, "doc", "text", "query", terms, {"KIND": "kind"}, 2)
    return found.select(
        F.col("candidate_tier").alias("tier"), F.col("preferred_label").alias("label"), F.array_join("synonyms", "|").alias("synonyms"), F.element_at("extra", "n").cast("long").alias("n"), F.element_at("extra", "queries").alias("queries"),
    )


@query(
    "p20_run_record",
    """SELECT 'resolve' AS command, n_regionkey::BIGINT AS region, sha256('{"nations":' || count(*) || ',"region":' || n_regionkey || ',"ü":["x"]}') AS config_hash, true AS has_id, true AS in_order FROM nation GROUP BY n_regionkey""",
)
def p20(t):
    folder = fresh_path(t.spark, "records")
    for r in t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n")).collect():  # a run a region
        runs.RunRecord("resolve", {"region": r.n_regionkey, "nations": r.n, "ü": ["x"]}).finish(t.spark, f"{folder}/{r.n_regionkey}.json")
    back = t.spark.read.schema("run_id string, config_hash string, started_at string, finished_at string, command string").option("multiLine", True).json(folder)
    region = F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long")
    return back.select("command", region.alias("region"), "config_hash", (F.length("run_id") == 32).alias("has_id"), (F.col("started_at") <= F.col("finished_at")).alias("in_order"))


@query("p10_list_load", "SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS position, p_name || ' ' || p_partkey AS item FROM part")
def p10(t):
    item = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    quoted = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  - '"), item, F.lit("'  # note"))).otherwise(F.concat(F.lit("  - "), item))
    head = t.spark.createDataFrame([(-3, "# names"), (-2, "names:"), (-1, "")], "at long, value string")
    lines = head.unionByName(t.part.select(F.col("p_partkey").alias("at"), quoted.alias("value")))
    lines.coalesce(1).sortWithinPartitions("at").select("value").write.text(path := fresh_path(t.spark, "list"))
    return runs.read_list(t.spark, path)


_TIER = "CASE WHEN p_size < 20 THEN 'program' ELSE 'cell' END"


@query(
    "p23_row_parsers",
    f"""SELECT 'concept' AS kind, p_partkey::VARCHAR AS id, {_TIER} AS tier, NULL AS organ, CASE WHEN p_size < 20 THEN 'gene' ELSE 'cell_type' END AS detail FROM part
UNION ALL SELECT 'place', n_nationkey::VARCHAR, 'morphology', CASE WHEN n_nationkey % 2 = 0 THEN 'x' END, n_name FROM nation UNION ALL SELECT 'prompt', r_regionkey::VARCHAR, 'cell', NULL, r_name FROM region""",
)
def p23(t):
    def trip(df):
        df.write.option("emptyValue", "").csv(path := fresh_path(t.spark, "tsv"), sep="\t", header=True)
        return files.read_tsv(t.spark, path)

    typed = trip(t.part.select(F.col("p_partkey").cast("string").alias("concept_id"), F.col("p_name").alias("concept_name"), F.when(F.col("p_size") < 20, "gene").otherwise("cell_type").alias("concept_type")))
    place = trip(t.nation.select(F.col("n_nationkey").cast("string").alias("concept_id"), F.col("n_name").alias("concept_name"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise("").alias("organ")))
    prompt = trip(t.region.select(F.col("r_regionkey").cast("string").alias("concept_id"), F.col("r_name").alias("concept_name"), F.lit("cell").alias("hierarchy"), F.lit("human").alias("species"), F.col("r_name").alias("prompt_text"), F.lit("shared").alias("species_status")))
    a = bank.typed_concepts(typed, {"gene": "program", "cell_type": "cell"}).select(F.lit("concept").alias("kind"), F.col("concept_id").alias("id"), "tier", "organ", F.col("concept_type").alias("detail"))
    b = bank.tiered_concepts(place, "morphology").select(F.lit("place").alias("kind"), F.col("concept_id").alias("id"), "tier", "organ", F.col("concept_name").alias("detail"))
    c = bank.prompt_rows(prompt, ["cell"], ["human"], ["shared"]).select(F.lit("prompt").alias("kind"), F.col("concept_id").alias("id"), "tier", F.lit(None).cast("string").alias("organ"), F.col("prompt_text").alias("detail"))
    return a.unionByName(b).unionByName(c)


@query(
    "p22_dropped_and_view_rows",
    "SELECT 'dropped' AS what, p_partkey AS id FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_size, lower(trim(p_name)) ORDER BY p_partkey) AS r FROM part) WHERE r > 1 UNION ALL SELECT 'flagged', p_partkey FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'all', p_partkey FROM part",
)
def p22(t):
    flagged = t.part.withColumn("in_view", F.when(F.col("p_size") % 2 == 0, True).when(F.col("p_size") % 3 == 0, False))
    dropped = lexicon.dropped_ids(t.part, "p_partkey", [F.col("p_size"), F.lower(F.trim("p_name"))], [F.col("p_partkey")])
    parts = {"dropped": dropped, "flagged": lexicon.view_rows(flagged, "in_view"), "all": lexicon.view_rows(t.part, "in_view")}
    a, b, c = (df.select(F.lit(name).alias("what"), F.col("p_partkey").alias("id")) for name, df in parts.items())
    return a.unionByName(b).unionByName(c)


@query("p25_without_adjudicator", "SELECT event_id, decision, 'skipped' AS answer FROM (SELECT event_id, CASE WHEN value < 3 THEN 'keep' WHEN value <= 30 THEN 'ambiguous' WHEN value > 30 THEN 'drop_far' END AS decision FROM events) WHERE decision IS DISTINCT FROM 'ambiguous'")
def p25(t):
    d = t.events.select("event_id", F.when(F.col("value") < 3, "keep").when(F.col("value") <= 30, "ambiguous").when(F.col("value") > 30, "drop_far").alias("decision"))
    return resolve.without_adjudicator(d, "decision").select("event_id", "decision", "answer")


_BYTES = ", ".join(f"('0x' || substr(h, {2 * i + 1}, 2))::INT - 127.5" for i in range(8))


@query("p27_batched_encoding", f"WITH e AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), v AS (SELECT doc_id, [{_BYTES}]::DOUBLE[] AS v FROM e) SELECT doc_id, round((v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))))::FLOAT::DOUBLE, 5) AS first, round((v[8] / sqrt(list_sum(list_transform(v, lambda x: x * x))))::FLOAT::DOUBLE, 5) AS last FROM v")
def p27(t):
    from ..sources.embedding import DigestEmbedder, embed

    out = embed(t.documents.where("text is not null"), "text", DigestEmbedder(8))
    return out.select("doc_id", *[F.round(F.element_at("embedding", i).cast("double"), 5).alias(n) for n, i in (("first", 1), ("last", 8))])


_RUNS = "SELECT ['euler', 'heun'][l_linenumber % 2 + 1] AS solver, l_linenumber AS steps, l_suppkey AS slide, l_partkey % 20 AS gene, l_quantity * 1500 AS pred, l_extendedprice AS target, l_returnflag <> 'R' AS mask FROM lineitem"


@query(
    "p28_validation_settings",
    f"""WITH r AS ({_RUNS}) SELECT solver, steps, round(sum((pred - target) ** 2) FILTER (mask) / count(*) FILTER (mask) / 1e6, 4) AS mse, round(sum(abs(pred - target)) FILTER (mask) / count(*) FILTER (mask), 4) AS mae, count(*) FILTER (mask) AS cells, count(DISTINCT slide) AS slides FROM r GROUP BY ALL""",
)
def p28(t):
    rows = t.lineitem.select(
        F.get(F.array(F.lit("euler"), F.lit("heun")), F.col("l_linenumber") % 2).alias("solver"), F.col("l_linenumber").alias("steps"), F.col("l_suppkey").alias("slide"), (F.col("l_partkey") % 20).alias("gene"),
        (F.col("l_quantity") * 1500).alias("pred"), F.col("l_extendedprice").alias("target"), (F.col("l_returnflag") != "R").alias("mask"),
    )
    out = st.evaluate(rows, ["solver", "steps"], "slide", "gene", "pred", "target", "mask")
    return out.select("solver", "steps", F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("mae", 4).alias("mae"), F.col("n").alias("cells"), F.col("units").alias("slides"))


@query(
    "d18_config_contract",
    """WITH b AS (SELECT p_brand AS name, round(avg(p_size) / 25, 2) AS v FROM part GROUP BY 1)
SELECT name, CASE WHEN v > 1 THEN 'within is out of range: ' || v ELSE 'ok' END AS outcome FROM b UNION ALL SELECT 'unknown', 'unknown settings: [''wihtin'']' UNION ALL SELECT 'order', 'drop is above keep'""",
)
def d18(t):
    def outcome(values):
        try:
            ViewConfig.of(values)
        except ValueError as e:
            return str(e)
        return "ok"

    within = F.udf(lambda v: outcome({"within": v}), "string")
    brands = t.part.groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_size") / 25, 2).alias("v"))
    fixed = t.spark.createDataFrame([("unknown", outcome({"wihtin": 0.5})), ("order", outcome({"keep": 0.2, "drop": 0.3}))], "name string, outcome string")
    return brands.select("name", within("v").alias("outcome")).unionByName(fixed)


@query("c03_density_clusters")
def c03_density(t):
    return density.density_clusters(t.embeddings, "vec_id", "embedding", 5, group="label", dims=16, above=100)


@query("c03_average_linkage")
def c03(t):
    return cluster.average_linkage(t.embeddings, "vec_id", "embedding", 0.2, "label")
