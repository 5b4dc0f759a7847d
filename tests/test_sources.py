import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.plans.stages import Stage, ViewConfig, run_stages
from strataloom.sources import files, markup
from strataloom.sources.embedding import HashEmbedder, embed
from strataloom.streaming import mentions


def test_typed_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], files.RAW_CONCEPTS)
    files.write_table(empty, f"{tmp_path}/e", files.RAW_CONCEPTS)
    assert files.read_typed(spark, f"{tmp_path}/e", files.RAW_CONCEPTS).count() == 0
    assert files.read_present(spark, [f"{tmp_path}/none"], "a int").columns == ["a"]
    with pytest.raises(Exception):
        files.write_table(spark.range(1), f"{tmp_path}/x", "other string")


def test_csv_index_and_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿,name\n0,x\n".encode())
    (tmp_path / "b.tsv").write_text("id\tname\n 1 \t\n")
    assert files.read_csv(spark, f"{tmp_path}/a.csv").columns[-1] == "name"
    assert [tuple(r) for r in files.read_tsv(spark, f"{tmp_path}/b.tsv").collect()] == [("1", "")]


def test_gene_sets_skip_short_lines(spark):
    lines = spark.createDataFrame([("A\tu\tx\ty",), ("B\tu",), ("C",), ("D\tu\t",)], "value string")
    assert [tuple(r) for r in files.parse_gene_sets(lines, "value").collect()] == [("A", "u", ["x", "y"])]


def test_articles(spark):
    xml = (
        "<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>{1}</ArticleTitle>{2}<Journal><Title>J</Title><JournalIssue><PubDate>"
        "<MedlineDate>2001 Spring</MedlineDate></PubDate></JournalIssue></Journal></Article><KeywordList><Keyword>k</Keyword></KeywordList></MedlineCitation></PubmedArticle>"
    )
    rows = [xml.format(1, "T", "<Abstract><AbstractText>plain</AbstractText></Abstract>"), xml.format(2, "", ""), xml.format("", "T", "")]
    got = markup.articles(spark.createDataFrame([(r,) for r in rows], "x string"), "x", []).collect()
    assert [(r.pmid, r.title, r.abstract, r.year, r.keywords, r.authors) for r in got] == [("1", "T", "plain", 2001, ["k"], [])]


def test_ontology_blank_terms(spark):
    js = ['{"@id": "i", "prefLabel": "L", "synonym": ["", "s"], "definition": [" ", "d"], "parents": [{"@id": "p"}]}', '{"@id": "j"}']
    got = markup.ontology_classes(spark.createDataFrame([(x,) for x in js], "j string"), "j", "src", "t").collect()
    assert [(r.source_id, r.synonyms, r.definition, r.parent_ids) for r in got] == [("i", ["s"], "d", ["p"])]


def test_embedder_contract(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    v = [r.embedding for r in embed(df, "t", HashEmbedder(16)).collect()]
    assert v[0] == v[1] != v[2] and v[3] is None


def test_embedder_gets_slices_of_a_batch(spark):
    class Bounded:
        dim = 1

        def encode(self, texts):
            if sum(map(len, texts)) > 3 << 20:
                raise ValueError("too much text at a time")
            return np.array([[len(t)] for t in texts], dtype=float)

    df = spark.range(0, 90, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"), "id")
    got = embed(df, "t", Bounded()).drop("t").collect()
    assert sorted(tuple(r) for r in got) == [(i, [100_000.0]) for i in range(90)]


def test_stages_resume(spark, tmp_path):
    calls = []

    def step(n):
        def run(df):
            calls.append(n)
            return df.withColumn(f"c{n}", F.lit(n))
        return Stage(f"s{n}", run)

    stages = [step(1), step(2)]
    assert run_stages(spark, spark.range(2), stages, str(tmp_path)).columns == ["id", "c1", "c2"]
    run_stages(spark, spark.range(2), stages, str(tmp_path), resume_from="s2")
    assert calls == [1, 2, 2]
    with pytest.raises(ValueError):
        ViewConfig.of({"unknown": 1})
    with pytest.raises(ValueError):
        ViewConfig(keep=0.1, drop=0.2)


def test_report(spark):
    text = files.report("R", {"t": spark.range(3)}, rows=2)
    assert "| id |" in text and "(the first 2 rows)" in text


def test_streams(spark, tmp_path):
    rows = [("a", i, float(v)) for i, v in enumerate([5, 4, 4, 1])]
    spark.createDataFrame(rows, "k string, s long, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, s long, v double").parquet(f"{tmp_path}/in")
    q = mentions.running_best(stream, "k", "s", "v", 0.5).writeStream.format("memory").queryName("best").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.s for r in spark.sql("select * from best").collect()) == [0, 1, 3]
    timed = spark.readStream.schema("k string, s long, v double").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("s"))
    q = mentions.windowed_counts(timed, "ts", "k", "1 minute", value="v").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.sql("select * from counts").collect()] == [(4, 14.0)]


def test_settled_best_does_not_depend_on_the_order_of_arrival(spark, tmp_path):
    import random

    from strataloom.operators import ranking

    rng = random.Random(6)
    rows = [(k, i, round(rng.uniform(0, 10) - i * 0.2, 3)) for k in "ab" for i in range(25)]
    schema = "k string, s long, v double"
    want = {tuple(r) for r in ranking.running_best(spark.createDataFrame(rows, schema), ["k"], "s", "v", 0.5).select("k", "step", "value").collect()}
    # Steps come up to seven places late, in files that are read one at a time; the last one moves the watermark on.
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 7))
    folder = tmp_path / "in"
    for n in range(0, len(shuffled), 10):
        spark.createDataFrame(shuffled[n : n + 10], schema).coalesce(1).write.mode("append").parquet(str(folder / f"p={n:03}"))
    spark.createDataFrame([("z", 10_000, 1.0)], schema).coalesce(1).write.parquet(str(folder / "p=900"))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema + ", p string").option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.timestamp_seconds(F.col("s") * 60 + 86_400))
        q = mentions.settled_best(stream, "k", "s", "v", "ts", 0.5, "10 minutes").writeStream.format("memory").queryName("settled").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset(name)
    assert {tuple(r) for r in spark.sql("select k, s, v from settled where k <> 'z'").collect()} == want
