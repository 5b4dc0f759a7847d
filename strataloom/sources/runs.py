"""Drivers of whole runs: sources in order, cached parts, records of runs."""

from __future__ import annotations

import hashlib
import json
import platform
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from . import files

FAILURES = "source string, error string, message string"


class LicenceRefused(Exception):
    """A source that cannot be read without a licence."""


def run_sources(spark: SparkSession, sources: Sequence[tuple[str, bool, Callable[[], DataFrame]]], ddl: str, skip_errors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of all sources that worked, failures): sources run in order.

    A source is (name, enabled, function).  Its frame is computed and stored
    under ``ddl`` at once, so an error that only shows when rows are made counts
    too.  With ``skip_errors`` it becomes a row of failures (name, kind,
    message) and the others go on; without, it is raised.  None that works gives
    a typed empty frame.
    """
    from ..operators.checks import to_schema

    done, failed = [], []
    for name, enabled, make in sources:
        if not enabled:
            continue
        try:
            done.append(stored(to_schema(make(), ddl), f"source-{name}"))
        except Exception as e:  # a failure of a source is its own, one of the session is not
            if not skip_errors or isinstance(e, MemoryError) or spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
                raise
            failed.append((name, type(e).__name__, str(e).split("\n")[0][:500]))
    rows = reduce(lambda a, b: a.unionByName(b), done) if done else spark.createDataFrame([], ddl)
    return rows, spark.createDataFrame(failed, FAILURES)


def term_lists(spark: SparkSession, classes: Mapping[str, Sequence[Callable[[], DataFrame]]], cache: str, most: int) -> DataFrame:
    """(class, term) of each class, from its cache or the first source that works.

    A source is a function to a frame with the column ``term``; at most ``most``
    terms are taken, in their order.  When a source refuses for want of a
    licence, the class's next one is asked; after any other failure, or when
    none is left, the class has no terms.  What was fetched is cached under
    ``cache/class``; failures are not.
    """
    found = []
    for name, sources in classes.items():
        path = f"{cache}/{name}"
        if not files.exists(spark, path):
            for source in sources:
                try:
                    terms = source().select(F.col("term").cast("string").alias("term")).where("term is not null").orderBy("term").limit(most)
                    terms.write.mode("overwrite").parquet(path)
                    break
                except LicenceRefused:
                    continue
                except Exception:  # noqa: BLE001  the class stays empty
                    break
        if files.exists(spark, path):
            found.append(files.read_typed(spark, path, "term string").select(F.lit(name).alias("class"), "term"))
    return reduce(lambda a, b: a.unionByName(b), found) if found else spark.createDataFrame([], "class string, term string")


def reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame], ddl: str) -> DataFrame:
    """The table at ``path``, built and stored there when it is absent."""
    if not files.exists(spark, path):
        files.write_table(build(), path, ddl)
    return files.read_typed(spark, path, ddl)


def harvest_gene_sets(spark: SparkSession, folder: str, collections: Mapping[str, str], download: Callable[[str, str], None]) -> DataFrame:
    """Raw concepts of gene-set files ``folder/name``; ``collections`` maps names to tiers.

    A file that is absent is asked of ``download(name, path)`` first.  Sets
    without members are left out; members are kept under ``genes`` in ``extra``.
    """
    parts = []
    for name, tier in collections.items():
        path = f"{folder}/{name}"
        if not files.exists(spark, path):
            download(name, path)
        sets = files.parse_gene_sets(spark.read.text(path), "value")
        empty = F.array().cast("array<string>")
        parts.append(sets.select(
            F.lit("gene_sets").alias("source_name"), F.concat(F.lit(f"{name}:"), "name").alias("source_id"), "name", empty.alias("synonyms"), F.col("url").alias("definition"),
            empty.alias("parent_ids"), F.lit(tier).alias("candidate_tier"), F.create_map(F.lit("genes"), F.array_join("members", ",")).alias("extra"),
        ).withColumnRenamed("name", "preferred_label"))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], files.RAW_CONCEPTS)


def harvest_mentions(texts: DataFrame, key: str, text: str, query: str, terms: DataFrame, tiers: Mapping[str, str], least: int, most_ids: int = 10, most_synonyms: int = 20) -> DataFrame:
    """Raw concepts mentioned in texts: tags, then entities by normalised form and tier.

    ``terms`` has form, label and expansion, as ``tag`` wants; labels without a
    tier are dropped.  Synonyms are other forms of the entity, as first seen.  No texts, or none with a tag, give a typed empty frame.
    """
    from ..functions.text import normalize_entity
    from ..operators import aggregates as ag
    from ..operators.tagging import tag

    tagged = tag(texts, key, text, terms).join(texts.select(key, query), key)
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv]), F.col("label"))
    rows = tagged.select(F.col(key).alias("doc"), "position", "form", tier.alias("tier"), normalize_entity(F.col("form"), []).alias("normal"), F.col(query).alias("query")).where("tier is not null and normal <> ''")
    rows = stored(rows, "tagged")  # read twice
    found = ag.mentions(rows, "form", "normal", "tier", "doc", "position", least, most_ids, "query", most_synonyms)
    return found.select(
        F.lit("texts").alias("source_name"), F.concat_ws(":", "tier", "normal").alias("source_id"), F.col("label").alias("preferred_label"), "synonyms",
        F.lit(None).cast("string").alias("definition"), F.array().cast("array<string>").alias("parent_ids"), F.col("tier").alias("candidate_tier"),
        F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("queries"), F.array_join("queries", ","), F.lit("ids"), F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",")).alias("extra"),
    )


def config_hash(config: Mapping) -> str:
    """sha256 of the configuration as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class RunRecord:
    """What ran, with which settings and code, and when; written as JSON.

    The caller knows the revision of the code and whether it has changes.
    """

    def __init__(self, command: str, config: Mapping, revision: str | None = None, dirty: bool = False):
        self.values = {
            "run_id": uuid.uuid4().hex, "revision": revision, "dirty": dirty, "config_hash": config_hash(config), "started_at": datetime.now(timezone.utc).isoformat(), "finished_at": None,
            "command": command, "python_version": platform.python_version(),
        }

    def finish(self, spark: SparkSession, path: str) -> dict:
        """Set the end and write the record to ``path`` on any store Spark knows."""
        self.values["finished_at"] = datetime.now(timezone.utc).isoformat()
        files.write_text(spark, path, json.dumps(self.values, indent=2))
        return self.values


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, item) of a file with one ``- item`` or ``item`` a line, in order.

    Blank lines, comments (``#``), keys (``name:``) and quotes around items are left out.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    item = F.trim(F.regexp_replace(F.regexp_replace("line", r"\s+#.*$", ""), r"^\s*-\s+", ""))
    items = lines.select("at", F.regexp_replace(item, r"^(['\"])(.*)\1$", "$2").alias("item")).where((F.col("item") != "") & ~F.col("item").rlike(r"^#|^[^'\"]*:$"))
    # A list of settings: it came as one value of one row, and is numbered there.
    gathered = items.agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("all"))
    return gathered.select(F.posexplode("all").alias("position", "x")).select("position", F.col("x.item").alias("item"))
