"""Search results, articles and ontology classes from XML and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTICLE = (
    "struct<MedlineCitation:struct<PMID:string,Article:struct<ArticleTitle:string,"
    "Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    "ArticleDate:array<struct<Year:string>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string>>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string,_UI:string>>>>,"
    "KeywordList:array<struct<Keyword:array<struct<_VALUE:string,_MajorTopicYN:string>>>>>,"
    "PubmedData:struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>>"
)
CLASS = "struct<`@id`:string,prefLabel:string,synonym:array<string>,definition:array<string>,parents:array<struct<`@id`:string>>>"


def element(markup: Column, name: str) -> Column:
    """The text of the first element of this name that holds text only; empty if there is none."""
    return F.regexp_extract(markup, rf"<{name}(?:\s[^>]*)?>([^<]*)</{name}>", 1)


def attribute(markup: Column, name: str, key: str) -> Column:
    """The value of this (double-quoted) attribute where an element of this name first has it."""
    return F.regexp_extract(markup, rf'<{name}(?:\s[^>]*)?\s{key}="([^"]*)"', 1)


def search_results(df: DataFrame, xml: str) -> DataFrame:
    """Adds count, ids, web_env, query_key and error of a search reply."""
    def text(path: str) -> Column:
        return F.nullif(F.xpath_string(F.col(xml), F.lit(path)), F.lit(""))

    return df.withColumns({
        "count": F.coalesce(text("/*/Count").cast("bigint"), F.lit(0)),
        "ids": F.xpath(F.col(xml), F.lit("/*/IdList/Id/text()")),
        "web_env": text("/*/WebEnv"), "query_key": text("/*/QueryKey"), "error": text("//ERROR"),
    })


def articles(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """One article per row of XML: pmid, title, abstract, journal, year, authors, mesh, keywords, doi.

    Labelled abstract parts become ``LABEL: text``, joined by blank lines; the
    year is that of the first date that starts with four digits; an author without
    a fore name has the initials; the doi is the first article id of that kind.
    Blank texts are left out, a blank journal or doi is null.  Rows without an id,
    or without title and abstract, are left out.
    """
    a = F.from_xml(F.col(xml), ARTICLE)
    m = df.select(*keep, a.alias("_a")).select(*keep, F.col("_a.MedlineCitation").alias("m"), F.col("_a.PubmedData.ArticleIdList.ArticleId").alias("_ids"))

    def text(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    def texts(values: Column) -> Column:
        found = F.transform(values, lambda x: text(x["_VALUE"]))
        return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<string>"))

    parts = F.filter(F.coalesce(F.col("m.Article.Abstract.AbstractText"), F.array().cast("array<struct<_VALUE:string,_Label:string>>")), lambda p: F.coalesce(F.trim(p._VALUE), F.lit("")) != "")
    abstract = F.array_join(F.transform(parts, lambda p: F.concat(F.coalesce(F.concat(p._Label, F.lit(": ")), F.lit("")), F.trim(p._VALUE))), "\n\n")
    date = F.col("m.Article.Journal.JournalIssue.PubDate")
    year = F.coalesce(*[F.nullif(F.regexp_extract(F.trim(d), r"^([0-9]{4})", 1), F.lit("")) for d in (date.Year, date.MedlineDate, F.get("m.Article.ArticleDate", F.lit(0)).Year)]).cast("int")
    dois = F.filter("_ids", lambda x: (x["_IdType"] == "doi") & text(x["_VALUE"]).isNotNull())
    out = m.select(
        *keep, text(F.col("m.PMID")).alias("pmid"), F.coalesce(F.trim("m.Article.ArticleTitle"), F.lit("")).alias("title"), abstract.alias("abstract"),
        text(F.col("m.Article.Journal.Title")).alias("journal"), year.alias("year"),
        F.coalesce(F.transform("m.Article.AuthorList.Author", lambda x: F.concat_ws(" ", F.coalesce(text(x.ForeName), text(x.Initials)), x.LastName)), F.array().cast("array<string>")).alias("authors"),
        texts(F.transform("m.MeshHeadingList.MeshHeading", lambda x: x.DescriptorName)).alias("mesh"),
        texts(F.flatten(F.transform("m.KeywordList", lambda x: x.Keyword))).alias("keywords"),
        F.trim(F.get(dois, F.lit(0))["_VALUE"]).alias("doi"),
    )
    return out.where(F.col("pmid").isNotNull() & ((F.col("title") != "") | (F.col("abstract") != "")))


def ontology_classes(df: DataFrame, js: str, source: str, tier: str) -> DataFrame:
    """Class documents to raw concepts; blank synonyms go, the first definition that is not blank stays.

    Classes without a label are left out.
    """
    c = df.select(F.from_json(js, CLASS).alias("c"))
    def full(x):
        return F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda s: F.trim(s) != "")

    return c.select(
        F.lit(source).alias("source_name"), F.col("c.`@id`").alias("source_id"), F.trim("c.prefLabel").alias("preferred_label"), full(F.col("c.synonym")).alias("synonyms"),
        F.get(full(F.col("c.definition")), F.lit(0)).alias("definition"),
        F.coalesce(F.transform("c.parents", lambda p: p["@id"]), F.array().cast("array<string>")).alias("parent_ids"),
        F.lit(tier).alias("candidate_tier"), F.create_map().cast("map<string,string>").alias("extra"),
    ).where(F.coalesce(F.col("preferred_label"), F.lit("")) != "")


def harvest(parts: dict[str, DataFrame], reject: list[str]) -> DataFrame:
    """Raw concepts of several sources without labels that have a rejected substring."""
    from functools import reduce

    from ..functions.text import contains_any

    all_ = reduce(lambda a, b: a.unionByName(b), parts.values())
    return all_.where(~contains_any(F.col("preferred_label"), reject)) if reject else all_
