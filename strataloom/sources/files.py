"""Readers and writers of text, JSON, Parquet and log files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_CONCEPTS = (
    "source_name string, source_id string, preferred_label string, synonyms array<string>, definition string, "
    "parent_ids array<string>, candidate_tier string, extra map<string,string>"
)
CONCEPTS = (
    "concept_id string, concept_name string, tier string, category string, subcategory string, source string, "
    "provenance string, organ string, level string, concept_type string"
)
PROMPTS = "concept_id string, concept_name string, tier string, species string, prompt_text string, species_status string"


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def read_typed(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Parquet under a fixed schema."""
    return spark.read.schema(ddl).parquet(path)


def write_table(df: DataFrame, path: str, ddl: str | None = None, mode: str = "errorifexists", codec: str = "snappy") -> None:
    """Columns, order and types of ``ddl``; an empty frame makes a typed empty table."""
    from ..operators.checks import to_schema

    (to_schema(df, ddl) if ddl else df).write.mode(mode).option("compression", codec).parquet(path)


def read_present(spark: SparkSession, paths: Sequence[str], ddl: str) -> DataFrame:
    """All rows of the files that exist; none that exist give a typed empty frame."""
    there = [p for p in paths if exists(spark, p)]
    return spark.read.schema(ddl).parquet(*there) if there else spark.createDataFrame([], ddl)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed strings; blanks stay blank."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False, nullValue="\x00", emptyValue="", quote="")
    return raw.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; an unnamed first column (a written index) is dropped.

    A byte-order mark before the first name is ignored.
    """
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.drop("_c0", "")


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    df.select(*columns).write.mode(mode).csv(path, header=True)


def read_runs(spark: SparkSession, pattern: str, ddl: str, file_name: str) -> DataFrame:
    """One JSON document per folder; the folder's name becomes the column ``run``."""
    df = spark.read.schema(ddl).option("multiLine", True).json(pattern)
    return df.withColumn("run", F.regexp_extract(F.input_file_name(), rf"([^/]+)/{file_name}$", 1))


def write_with_sidecar(df: DataFrame, path: str, vector: str, mode: str = "errorifexists") -> dict:
    """Vectors as zstd Parquet and a JSON record of dimension, rows and time beside it."""
    write_table(df, path, mode=mode, codec="zstd")
    spark = df.sparkSession
    row = spark.read.parquet(path).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d"), F.min(F.size(vector)).alias("d0")).first()
    if row.d != row.d0:
        raise ValueError("vectors of different dimensions")
    record = {"D": row.d, "n_rows": row.n, "created_at": datetime.now(timezone.utc).isoformat()}
    write_text(spark, f"{path.rstrip('/')}.json", json.dumps(record))
    return record


def parse_log(lines: DataFrame, column: str, pattern: str, fields: dict[str, str]) -> DataFrame:
    """Typed rows of the lines that match; ``fields`` maps group names in order to types."""
    hit = lines.where(F.col(column).rlike(pattern))
    return hit.select(*[F.regexp_extract(column, pattern, i).cast(kind).alias(name) for i, (name, kind) in enumerate(fields.items(), 1)])


def parse_gene_sets(lines: DataFrame, column: str) -> DataFrame:
    """Ragged tab-separated sets: name, url, members; lines without members are skipped."""
    parts = F.split(column, "\t")
    members = F.filter(F.transform(F.slice(parts, 3, 1 << 30), lambda x: F.trim(x)), lambda x: x != "")
    return lines.where(F.size(parts) >= 3).select(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("url"), members.alias("members")).where(F.size("members") > 0)


def write_gene_sets(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "name", "url", F.array_join("members", "\t")).alias("value")).write.text(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """The files and folders in a folder, sorted; none if it is not there."""
    fs, p = _filesystem(spark, path)
    return sorted(f.getPath().toString() for f in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        fs, p = _filesystem(spark, path)
        fs.delete(p, True)


def fresh_name(start: str) -> str:
    """A path that nobody else has."""
    return f"{start}{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any store that Spark knows; it replaces an older one."""
    fs, p = _filesystem(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_vectors(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """(position, id, vector) of a vector table: the rows of a matrix in the order of the id.

    Rows of another dimension than the first's are an error; null vectors have
    no row.  The matrix stays a table: positions are given without gathering it.
    """
    from ..operators.ranking import positions

    rows = spark.read.parquet(path).select(F.col(key).alias("id"), F.col(vector).alias("vector")).where("vector is not null")
    d = rows.select(F.size("vector").alias("d")).agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    if d.lo != d.hi:
        raise ValueError(f"vectors of dimensions {d.lo} to {d.hi}")
    return positions(rows, [F.col("id")], "position").select("position", "id", "vector")


def read_splits(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The split files as one table with a column ``split``; columns may differ."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_csv(spark, p).withColumn("split", F.lit(k)) for k, p in files.items()])


def report(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """Markdown of small summary tables; longer ones are cut at ``rows`` and say so."""
    out = [f"# {title}"]
    for name, df in tables.items():
        got = df.limit(rows + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got[:rows]]
        if len(got) > rows:
            out.append(f"\n(the first {rows} rows)")
    return "\n".join(out) + "\n"
