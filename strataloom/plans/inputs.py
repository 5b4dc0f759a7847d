"""Sources and sinks (S) on the driver tables, by round trips through files."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..sources import files, markup
from ..storage import fresh_path, stored
from .registry import query


@query("s01_typed_round_trip", "SELECT doc_id::VARCHAR AS source_id, lang AS candidate_tier, 2 AS n, sha256(text) AS label FROM documents")
def s01(t):
    raw = t.documents.select(
        F.col("source").alias("source_name"), F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("preferred_label"), F.array("source", "lang").alias("synonyms"),
        F.lit(None).cast("string").alias("definition"), F.array().cast("array<string>").alias("parent_ids"), F.col("lang").alias("candidate_tier"), F.create_map().cast("map<string,string>").alias("extra"),
    )
    files.write_table(raw, path := fresh_path(t.spark, "raw"), files.RAW_CONCEPTS)
    return files.read_typed(t.spark, path, files.RAW_CONCEPTS).select("source_id", "candidate_tier", F.size("synonyms").alias("n"), F.sha2("preferred_label", 256).alias("label"))


@query("s03_concatenate_present", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s03(t):
    paths = [fresh_path(t.spark, "part") for _ in range(3)]
    files.write_table(t.nation.where("n_nationkey < 10"), paths[0])
    files.write_table(t.nation.where("n_nationkey >= 10"), paths[2])
    return files.read_present(t.spark, paths, t.nation.select("n_nationkey", "n_name", "n_regionkey").schema.simpleString()[7:-1].replace(":", " "))


@query("s05_tsv_trim_blank", "SELECT doc_id::VARCHAR AS doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source FROM documents")
def s05(t):
    out = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit(" "), "lang", F.lit("  ")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"))
    out.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path := fresh_path(t.spark, "tsv"), sep="\t", header=True)
    return files.read_tsv(t.spark, path)


@query("s07_csv_round_trip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def s07(t):
    files.write_csv(t.customer, path := fresh_path(t.spark, "csv"), ["c_custkey", "c_name"])
    return files.read_csv(t.spark, path)


@query("s09_runs_by_folder", "SELECT event_type AS run, count(*) AS n, round(avg(value), 6) AS mse FROM events GROUP BY 1")
def s09(t):
    g = t.events.groupBy(F.concat(F.lit("method_"), "event_type").alias("run")).agg(F.count("*").alias("n"), F.avg("value").alias("mse"))
    g.repartition("run").write.partitionBy("run").json(path := fresh_path(t.spark, "runs"))
    runs = files.read_runs(t.spark, f"{path}/run=*/*.json", "n bigint, mse double", r"[^/]+\.json")
    return runs.select(F.regexp_replace("run", "^run=method_", "").alias("run"), "n", F.round("mse", 6).alias("mse"))


@query("s10_vectors_with_sidecar", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total, (SELECT count(*) FROM embeddings) AS n_rows, 64 AS d FROM embeddings")
def s10(t):
    files.write_with_sidecar(t.embeddings.select("vec_id", "embedding"), path := fresh_path(t.spark, "vectors"), "embedding")
    side = t.spark.read.schema("D int, n_rows bigint, created_at timestamp").json(f"{path}.json").where("created_at is not null").first()
    total = F.aggregate(vx.as_double(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return t.spark.read.parquet(path).select("vec_id", F.round(total, 5).alias("total"), F.lit(side.n_rows).alias("n_rows"), F.lit(side.D).alias("d"))


@query("s12_log_parse", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'view'")
def s12(t):
    line = F.when(F.col("event_type") != "view", F.concat(F.lit("epoch "), F.col("event_id").cast("string"), F.lit(" | "), "event_type", F.lit(" loss="), F.col("value").cast("string"))).otherwise("-- noise --")
    t.events.select(line.alias("value")).write.text(path := fresh_path(t.spark, "log"))
    fields = {"event_id": "bigint", "event_type": "string", "value": "double"}
    return files.parse_log(t.spark.read.text(path), "value", r"^epoch ([0-9]+) \| (\w+) loss=([0-9.E-]+)$", fields)


@query("s13_gene_sets", "SELECT p_brand AS name, count(DISTINCT p_name) AS n FROM part GROUP BY 1")
def s13(t):
    g = t.part.groupBy(F.col("p_brand").alias("name")).agg(F.collect_set("p_name").alias("members")).select("name", F.lit("http://x.example").alias("url"), "members")
    files.write_gene_sets(g, path := fresh_path(t.spark, "sets"))
    lines = t.spark.read.text(path).unionByName(t.spark.createDataFrame([("short\tline",), ("empty\turl\t \t",)], "value string"))
    return files.parse_gene_sets(lines, "value").select("name", F.size("members").cast("long").alias("n"))


@query("s14_search_xml", "SELECT c_custkey, c_nationkey::BIGINT AS n, '1,' || c_custkey AS ids, CASE WHEN c_custkey % 2 = 0 THEN 'w' || c_custkey END AS web_env FROM customer")
def s14(t):
    env = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<WebEnv>w"), F.col("c_custkey").cast("string"), F.lit("</WebEnv>"))).otherwise("")
    xml = F.concat(F.lit("<r><Count>"), F.col("c_nationkey").cast("string"), F.lit("</Count>"), env, F.lit("<IdList><Id>1</Id><Id>"), F.col("c_custkey").cast("string"), F.lit("</Id></IdList></r>"))
    out = markup.search_results(t.customer.select("c_custkey", xml.alias("xml")), "xml")
    return out.select("c_custkey", F.col("count").alias("n"), F.array_join("ids", ",").alias("ids"), "web_env")


@query(
    "s15_article_xml",
    """SELECT p_partkey::VARCHAR AS pmid, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS title, 'AIM: ' || p_type || chr(10) || chr(10) || p_brand AS abstract,
CASE WHEN p_partkey % 3 = 2 THEN 2001 ELSE 1990 + p_size END AS year, 'A ' || p_brand || ';B X;J Y' AS authors,
CASE WHEN p_partkey % 4 > 0 THEN 'J ' || p_brand END AS journal, CASE WHEN p_partkey % 2 = 0 THEN p_type || ';Humans' ELSE '' END AS mesh, p_brand || ';k' || p_size AS keywords,
CASE WHEN p_partkey % 6 < 4 THEN '10.1/' || p_partkey END AS doi FROM part WHERE p_partkey % 7 <> 0""",
)
def s15(t):
    key = F.col("p_partkey")

    def tag(name, c):
        return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name.split()[0]}>"))

    pmid = F.when(key % 7 == 0, "").otherwise(tag("PMID", key.cast("string")))
    title = F.when(key % 5 == 0, "").otherwise(tag("ArticleTitle", F.col("p_name")))
    abstract = F.concat(tag('AbstractText Label="AIM"', F.col("p_type")), tag("AbstractText", F.col("p_brand")))
    year = (F.col("p_size") + 1990).cast("string")
    date = F.when(key % 3 == 0, tag("Year", year)).when(key % 3 == 1, tag("MedlineDate", F.concat(year, F.lit(" Jan-Feb")))).otherwise(tag("MedlineDate", F.lit("Winter")))
    journal = F.when(key % 4 > 0, tag("Title", F.concat(F.lit(" J "), "p_brand", F.lit(" ")))).otherwise("")
    authors = F.concat(
        F.lit("<Author><LastName>"), "p_brand", F.lit("</LastName><ForeName>A</ForeName></Author><Author><LastName>X</LastName><ForeName>B</ForeName><Initials>Q</Initials></Author>"),
        F.lit("<Author><LastName>Y</LastName><Initials>J</Initials></Author>"),
    )
    heading = F.concat(tag("MeshHeading", tag('DescriptorName UI="D1"', F.col("p_type"))), F.lit('<MeshHeading><DescriptorName UI="D2">Humans</DescriptorName></MeshHeading>'))
    mesh = F.when(key % 2 == 0, tag("MeshHeadingList", heading)).otherwise("")
    keywords = F.concat(tag("KeywordList", tag('Keyword MajorTopicYN="N"', F.col("p_brand"))), F.lit("<KeywordList><Keyword> </Keyword><Keyword>k"), F.col("p_size").cast("string"), F.lit("</Keyword></KeywordList>"))
    # One in six has no list, one in six no doi in it.
    doi = F.when(key % 6 < 4, tag('ArticleId IdType="doi"', F.concat(F.lit(" 10.1/"), key.cast("string")))).otherwise("")
    ids = F.when(key % 6 == 5, "").otherwise(tag("PubmedData", tag("ArticleIdList", F.concat(F.lit('<ArticleId IdType="pii">S1</ArticleId>'), doi))))
    parts = [
        F.lit("<PubmedArticle><MedlineCitation>"), pmid, F.lit("<Article>"), title, tag("Abstract", abstract), tag("Journal", F.concat(journal, tag("JournalIssue", tag("PubDate", date)))),
        tag("AuthorList", authors), F.lit("<ArticleDate><Year>2001</Year></ArticleDate></Article>"), mesh, keywords, F.lit("</MedlineCitation>"), ids, F.lit("</PubmedArticle>"),
    ]
    out = markup.articles(t.part.select("p_partkey", F.concat(*parts).alias("xml")), "xml", ["p_partkey"])
    joined = [F.array_join(c, ";").alias(c) for c in ("authors", "mesh", "keywords")]
    return out.select("pmid", "title", "abstract", "year", "journal", "doi", *joined)


@query("s15b_markup_extract", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS link FROM pages")
def s15b(t):
    return t.pages.select("page_id", markup.element(F.col("html"), "title").alias("title"), markup.attribute(F.col("html"), "a", "href").alias("link"))


@query("s16_ontology_json", "SELECT 'http://x/' || p_partkey AS source_id, p_name AS preferred_label, 1 AS n_synonyms, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS definition FROM part WHERE p_partkey % 9 <> 0")
def s16(t):
    label = F.when(F.col("p_partkey") % 9 == 0, F.lit(None)).otherwise(F.col("p_name"))
    js = F.to_json(F.struct(F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string")).alias("@id"), label.alias("prefLabel"), F.array(F.lit(" "), "p_brand").alias("synonym"), F.array(F.lit(""), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")).alias("definition")))
    out = markup.ontology_classes(t.part.select(js.alias("js")), "js", "own", "tissue")
    return out.select("source_id", "preferred_label", F.size("synonyms").alias("n_synonyms"), "definition")


@query("s19_harvest", "SELECT 'a' AS source_name, n_name AS preferred_label FROM nation WHERE NOT contains(n_name, '_1') UNION ALL SELECT 'b', r_name FROM region WHERE NOT contains(lower(r_name), '_1')")
def s19(t):
    parts = {"a": t.nation.select(F.lit("a").alias("source_name"), F.col("n_name").alias("preferred_label")), "b": t.region.select(F.lit("b").alias("source_name"), F.col("r_name").alias("preferred_label"))}
    return markup.harvest(parts, ["_1"])


@query("s20_cache_key", "SELECT page_id, sha256(split_part(url, '?', 1) || '?page=1&ref=a') AS key FROM pages")
def s20(t):
    params = F.create_map(*map(F.lit, ("ref", "a", "apikey", "secret", "page", "1")))
    return t.pages.select("page_id", tx.request_key(F.split("url", r"\?")[0], params, ["apikey"]).alias("key"))


@query(
    "s21_cache_miss_antijoin",
    """WITH d AS (SELECT sha256(text) AS text_hash, bool_or(doc_id % 2 = 0) AS cached FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT text_hash, NOT cached AS encoded, round((('0x' || substr(text_hash, 1, 2))::INT - 127.5) / (('0x' || substr(text_hash, 3, 2))::INT - 127.5), 2) AS ratio, (SELECT count(*) FILTER (NOT cached) FROM d) AS asked, 0 AS again FROM d""",
)
def s21(t):
    from ..sources.embedding import EmbeddingCache, embedder

    e, cache = embedder("digest", dim=8), EmbeddingCache(fresh_path(t.spark, "cache"), "digest")
    # Half of the texts are in the cache already; only the others are encoded, and nothing the third time.
    first, _ = cache.through(t.documents.where("doc_id % 2 = 0"), "text", e)
    known = stored(first.select("text_hash", F.lit(False).alias("encoded")), "known")
    _, asked = cache.through(t.documents, "text", e)
    cache.compact(t.spark)
    again = cache.through(t.documents, "text", e)[1]
    ratio = F.element_at("embedding", 1).cast("double") / F.element_at("embedding", 2).cast("double")
    vectors = cache.vectors(t.spark).join(known, "text_hash", "left")
    return vectors.select("text_hash", F.coalesce("encoded", F.lit(True)).alias("encoded"), F.round(ratio, 2).alias("ratio"), F.lit(asked).cast("long").alias("asked"), F.lit(again).alias("again"))


@query("s23_split_files", "SELECT CASE WHEN n_nationkey < 20 THEN 'train' ELSE 'test' END AS split, n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey < 20 THEN n_name END AS name, CASE WHEN n_nationkey >= 20 THEN n_regionkey::VARCHAR END AS region FROM nation")
def s23(t):
    a, b = fresh_path(t.spark, "train"), fresh_path(t.spark, "test")
    files.write_csv(t.nation.where("n_nationkey < 20"), a, ["n_nationkey", "n_name"])
    files.write_csv(t.nation.where("n_nationkey >= 20"), b, ["n_nationkey", "n_regionkey"])
    rows = files.read_splits(t.spark, {"train": a, "test": b})
    return rows.select("split", F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))


@query(
    "s25_publish",
    """SELECT n_nationkey AS id, n_name AS name, 2 AS version, 'complete' AS status, 0 AS bad_files, 25 AS before FROM nation WHERE n_nationkey % 2 = 0""",
)
def s25(t):
    from ..sources import publication as pub

    path = fresh_path(t.spark, "published")
    rows = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    first = pub.publish(rows.repartition(3), path)
    second = pub.publish(rows.where("id % 2 = 0").repartition(2), path, expected=first)
    bad, before = pub.mismatches(t.spark, path).count(), pub.read(t.spark, path, first).count()
    now = pub.current(t.spark, path)
    return pub.read(t.spark, path).select("id", "name", F.lit(second).alias("version"), F.lit(now["status"]).alias("status"), F.lit(bad).alias("bad_files"), F.lit(before).alias("before"))


@query(
    "p19_cache_stats",
    """WITH r AS (SELECT DISTINCT c_nationkey % 3 AS kind, c_custkey, 'reply ' || c_name AS body FROM customer)
SELECT kind, count(*) AS entries, sum(strlen(body))::BIGINT AS bytes FROM r WHERE kind <> 1 GROUP BY 1 UNION ALL SELECT 1, 0, 0""",
)
def p19(t):
    from ..sources.cache import ResponseCache

    def requests(kind):
        key = F.create_map(F.lit("id"), F.col("c_custkey").cast("string"))
        return t.customer.where(F.col("c_nationkey") % 3 == kind).select(F.lit(f"/kind/{kind}").alias("path"), key.alias("params"), F.lit(200).alias("status"), F.concat(F.lit("reply "), "c_name").alias("body"))

    out = []
    for kind in range(3):
        kept = ResponseCache(fresh_path(t.spark, "replies"))
        kept.put(requests(kind))
        kept.put(requests(kind))  # the second run leaves one entry a request
        if kind == 1:
            kept.invalidate(requests(kind).select("path", "params"))
        out.append(kept.stats(t.spark).select(F.lit(kind).alias("kind"), "entries", "bytes"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _bank(t):
    """Parts as concepts: three tiers by size, two prompts each."""
    from ..sources.bank import Bank

    tier = F.when(F.col("p_size") < 20, "H1").when(F.col("p_size") < 40, "H2").otherwise("H3")
    null = F.lit(None).cast("string")
    c = t.part.select(
        F.format_string("%s-%05d", tier, F.col("p_partkey")).alias("concept_id"), F.col("p_name").alias("concept_name"), tier.alias("tier"), F.col("p_type").alias("category"), null.alias("subcategory"),
        F.col("p_brand").alias("source"), F.lit("own").alias("provenance"), F.col("p_brand").alias("organ"), F.when(F.col("p_size") % 5 != 0, "cell").alias("level"), F.col("p_type").alias("concept_type"),
    )
    p = c.select("concept_id", "concept_name", "tier", F.explode(F.array(F.lit("human"), F.lit("mouse"))).alias("species"), F.col("concept_name").alias("prompt_text"), F.lit("shared").alias("species_status"))
    return Bank(c, p)


_RAW = "source_name string, source_id string, preferred_label string, synonyms array<string>, definition string, parent_ids array<string>, candidate_tier string, extra map<string,string>"


@query(
    "s02_empty_table",
    "SELECT split_part(c, ' ', 1) AS name, split_part(c, ' ', 2) AS kind, (SELECT count(*) FROM part) AS n, (SELECT count(DISTINCT p_name) FROM part) AS labels, 0::BIGINT AS n_empty FROM (SELECT unnest(string_split('" + _RAW + "', ', ')) AS c)",
)
def s02(t):
    empty, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    rows = t.part.select(
        F.lit("own").alias("source_name"), F.col("p_partkey").cast("string").alias("source_id"), F.col("p_name").alias("preferred_label"), empty.alias("synonyms"), none.alias("definition"),
        empty.alias("parent_ids"), F.col("p_type").alias("candidate_tier"), F.create_map().cast("map<string,string>").alias("extra"),
    )
    full, none_left = fresh_path(t.spark, "raw"), fresh_path(t.spark, "empty")
    files.write_table(rows, full, files.RAW_CONCEPTS)
    files.write_table(rows.where("source_id is null"), none_left, files.RAW_CONCEPTS)
    n = files.read_typed(t.spark, full, files.RAW_CONCEPTS).agg(F.count("*").alias("n"), F.count_distinct("preferred_label").alias("labels"))
    m = files.read_typed(t.spark, none_left, files.RAW_CONCEPTS).agg(F.count("*").alias("n_empty"))
    found = t.spark.read.parquet(none_left).schema.fields  # the schema is that of the file, read without one
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found], "name string, kind string").join(n).join(m)


@query(
    "s04_bank_round_trip",
    """WITH c AS (SELECT *, CASE WHEN p_size < 20 THEN 'H1' WHEN p_size < 40 THEN 'H2' ELSE 'H3' END AS tier FROM part)
SELECT printf('%s-%05d', tier, p_partkey) AS concept_id, p_name AS concept_name, tier, p_type AS category, 2 AS prompts, 'own' AS provenance FROM c""",
)
def s04(t):
    from ..sources.bank import read_bank

    _bank(t).write(path := fresh_path(t.spark, "bank"))
    bank = read_bank(t.spark, path, ["human", "mouse"])
    prompts = bank.prompts.groupBy("concept_id").agg(F.count("*").alias("prompts"))
    return bank.concepts.select("concept_id", "concept_name", "tier", "category").join(prompts, "concept_id").join(bank.provenance())


@query("s04b_bank_row_rules", "SELECT 'organ and level' AS rule, count(*) AS n FROM part WHERE p_size < 20 AND p_size % 5 = 0")
def s04b(t):
    found = _bank(t).row_violations({"H1": "H1", "H2": "H2", "H3": "H3"}, ["cell", "tissue"], "H1", ["H2"])
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("s06_tsv_bank", "SELECT CASE WHEN n_nationkey < 12 THEN 'low' ELSE 'high' END AS tier, count(*) AS concepts, count(*) FILTER (n_nationkey % 2 = 0) AS organs, count(*) AS prompts FROM nation GROUP BY ALL")
def s06(t):
    from ..sources.bank import load_tsv_bank

    ids = F.format_string("%s-%04d", F.when(F.col("n_nationkey") < 12, "LO").otherwise("HI"), F.col("n_nationkey"))
    a = t.nation.where("n_nationkey < 12").select(ids.alias("concept_id"), F.col("n_name").alias("concept_name"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise(" ").alias("organ"))
    b = t.nation.where("n_nationkey >= 12").select(ids.alias("concept_id"), F.col("n_name").alias("concept_name"), F.when(F.col("n_nationkey") % 2 == 0, "y").otherwise("").alias("organ"), F.lit("k").alias("category"))
    p = t.nation.select(ids.alias("concept_id"), F.col("n_name").alias("concept_name"), F.lit("human").alias("species"), F.lit("text").alias("prompt_text"), F.lit("old").alias("species_status"))
    paths = [fresh_path(t.spark, x) for x in ("a", "b", "p")]
    for df, path in zip((a, b, p), paths):
        df.write.option("emptyValue", "").csv(path, sep="\t", header=True)
    bank = load_tsv_bank(t.spark, paths[:2], paths[2], {"LO": "low", "HI": "high"}, {"old": "shared"})
    prompts = bank.prompts.where("species_status = 'shared'").groupBy("tier").agg(F.count("*").alias("prompts"))
    return bank.concepts.groupBy("tier").agg(F.count("*").alias("concepts"), F.count("organ").alias("organs")).join(prompts, "tier")


@query("s24_idempotent_sink", "SELECT r_regionkey AS k, r_name AS name, true AS refused FROM region")
def s24(t):
    path = fresh_path(t.spark, "once")
    files.write_table(t.region, path)
    files.write_table(t.nation, path, mode="ignore")
    try:
        files.write_table(t.nation, path)
        refused = False
    except AnalysisException:
        refused = True
    return t.spark.read.parquet(path).select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit(refused).alias("refused"))


@query(
    "s26_report",
    """SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation WHERE n_nationkey < 20 UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region
UNION ALL SELECT unnest(['# Coverage', '## regions', '## nations', '| r_regionkey | r_name |', '| n_nationkey | n_name |', '|---|---|', '|---|---|', '(the first 20 rows)'])""",
)
def s26(t):
    tables = {"regions": t.region.orderBy("r_regionkey").select("r_regionkey", "r_name"), "nations": t.nation.orderBy("n_nationkey").select("n_nationkey", "n_name")}
    files.write_text(t.spark, path := fresh_path(t.spark, "report") + ".md", files.report("Coverage", tables, 20))
    return t.spark.read.text(path).select(F.col("value").alias("line")).where("line <> ''")


@query("d14_hash_manifest", "SELECT 'hash' AS rule, 'gone.txt' AS key, 'missing' AS detail")
def d14(t):
    from ..operators.checks import hash_mismatches

    t.region.select("r_name").coalesce(1).write.text(path := fresh_path(t.spark, "hashed"))
    read = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    manifest = read.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return hash_mismatches(read, manifest.unionByName(t.spark.createDataFrame([("gone.txt", "00")], "name string, sha256 string")))


@query("p12_thresholds_with_defaults", "SELECT lang AS tier, CASE WHEN lang = 'en' THEN 0.6 ELSE 0.55 END::DOUBLE AS keep, 0.35::DOUBLE AS \"drop\" FROM documents GROUP BY 1")
def p12(t):
    from ..operators.resolve import thresholds

    t.spark.createDataFrame([("en", 0.6, None)], "tier string, keep double, drop double").write.parquet(path := fresh_path(t.spark, "thresholds"))
    saved = files.read_typed(t.spark, path, "tier string, keep double, drop double")
    return thresholds(t.documents.select(F.col("lang").alias("tier")), "tier", saved, {"keep": 0.55, "drop": 0.35})


@query("p26_alias_dictionary", "SELECT alias, min_by(value, priority) AS value FROM (SELECT lower(n_name) AS alias, n_name AS value, 1 AS priority FROM nation UNION ALL SELECT 'nation_3', 'override', 2 UNION ALL SELECT 'extra', 'literal', 2) GROUP BY 1")
def p26(t):
    from ..operators.rules import alias_table

    return alias_table([(t.nation, "n_name", "n_name")], {"Nation_3": "override", "extra": "literal"})


@query("p29_prompt_coverage", "SELECT tier, count(*) AS prompts, count(DISTINCT concept_id) AS concepts FROM (SELECT CASE WHEN p_size < 20 THEN 'H1' WHEN p_size < 40 THEN 'H2' ELSE 'H3' END AS tier, p_partkey AS concept_id FROM part, range(2)) GROUP BY 1")
def p29(t):
    return _bank(t).prompts.groupBy("tier").agg(F.count("*").alias("prompts"), F.count_distinct("concept_id").alias("concepts"))
