"""A concept bank: concepts and their prompts, checked when read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as ck
from . import files


@dataclass(frozen=True)
class Bank:
    concepts: DataFrame
    prompts: DataFrame

    def violations(self, species: list[str]) -> DataFrame:
        """Repeated ids, prompts without concept and the reverse, differing names or
        tiers, keys without exactly these species, mixed species status."""
        c, p = self.concepts, self.prompts
        keyed = p.withColumn("prompt_key", F.concat_ws("|", "concept_id", "species"))
        return ck.all_of(
            ck.duplicates(c, "concept_id"), ck.duplicates(keyed, "prompt_key"), ck.references(c, "concept_id", p), ck.consistent(c, p, "concept_id", "concept_name"),
            ck.consistent(c, p, "concept_id", "tier"), ck.complete_categories(p, "concept_id", "species", species), ck.uniform(p, "concept_id", "species_status"),
        )

    def row_violations(self, prefixes: dict[str, str], levels: list[str], needs_organ: str, needs_type: list[str]) -> DataFrame:
        """Ids that do not fit their tier, unknown tiers, required fields that are missing."""
        prefix = F.element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), F.col("tier"))
        rules: dict[str, Column] = {
            "tier": F.col("tier").isin(*prefixes),
            "id": F.coalesce(F.col("concept_id").rlike(r"^[A-Z0-9]+-[0-9]{4,}$") & F.col("concept_id").startswith(F.concat(prefix, F.lit("-"))), F.lit(False)),
            "organ and level": (F.col("tier") != needs_organ) | (F.col("organ").isNotNull() & F.col("level").isin(*levels)),
            "concept type": ~F.col("tier").isin(*needs_type) | F.col("concept_type").isNotNull(),
        }
        return ck.row_rules(self.concepts, "concept_id", rules)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        files.write_table(self.concepts, f"{path}/concepts", files.CONCEPTS, mode)
        files.write_table(self.prompts, f"{path}/prompts", files.PROMPTS, mode)

    def provenance(self, default: str = "mixed") -> DataFrame:
        """The one provenance of all concepts, or the default."""
        p = self.concepts.agg(F.count_distinct("provenance").alias("n"), F.min("provenance").alias("p"))
        return p.select(F.when(F.col("n") == 1, F.col("p")).otherwise(default).alias("provenance"))


def read_bank(spark: SparkSession, path: str, species: list[str] | None = None) -> Bank:
    """With ``species`` the bank is checked first, and the first violation is an error."""
    bank = Bank(files.read_typed(spark, f"{path}/concepts", files.CONCEPTS), files.read_typed(spark, f"{path}/prompts", files.PROMPTS))
    if species is not None:
        ck.fail_on(bank.violations(species)).collect()
    return bank


def _concept_rows(df: DataFrame, given: dict[str, Column], provenance: str) -> DataFrame:
    from ..functions.text import blank_to_null

    names = [x.split()[0] for x in files.CONCEPTS.split(", ")]
    own = {n: blank_to_null(F.col(n)) if n in df.columns else F.lit(None).cast("string") for n in names}
    own |= {"provenance": F.lit(provenance)} | given
    return df.select(*[own[n].cast("string").alias(n) for n in names])


def tiered_concepts(df: DataFrame, tier: str, provenance: str = "reference") -> DataFrame:
    """Concepts of one tier from all-string rows with organ and level; they have no type."""
    return _concept_rows(df, {"tier": F.lit(tier), "concept_type": F.lit(None)}, provenance)


def typed_concepts(df: DataFrame, tier_by_type: dict[str, str], provenance: str = "reference") -> DataFrame:
    """Concepts whose type says the tier, an unknown type being an error; they have no organ or level."""
    from ..functions.text import map_or_fail

    return _concept_rows(df, {"tier": map_or_fail(F.col("concept_type"), tier_by_type), "organ": F.lit(None), "level": F.lit(None)}, provenance)


def prompt_rows(df: DataFrame, tiers: list[str], species: list[str], statuses: list[str]) -> DataFrame:
    """Prompts from all-string rows (``hierarchy`` is the tier); values that are not listed are an error."""
    from ..functions.text import map_or_fail

    def one_of(column: str, values: list[str]) -> Column:
        return map_or_fail(F.col(column), {v: v for v in values})

    return df.select(
        "concept_id", "concept_name", one_of("hierarchy", tiers).alias("tier"), one_of("species", species).alias("species"), "prompt_text", one_of("species_status", statuses).alias("species_status")
    )


def load_tsv_bank(spark: SparkSession, concept_files: list[str], prompt_file: str, tier_by_prefix: dict[str, str], legacy_status: dict[str, str]) -> Bank:
    """Concepts of several TSV files (columns may differ) and prompts of one.

    The tier follows from the id's prefix, an unknown one being an error; old
    species statuses are mapped, others must be known values already.
    """
    from ..functions.text import blank_to_null, map_or_fail

    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [files.read_tsv(spark, f) for f in concept_files])
    names = [x.split()[0] for x in files.CONCEPTS.split(", ")]
    tier = map_or_fail(F.split("concept_id", "-")[0], tier_by_prefix)
    cells = {n: blank_to_null(F.col(n)) if n in raw.columns else F.lit(None).cast("string") for n in names}
    concepts = raw.select(*[(tier if n == "tier" else F.lit("reference") if n == "provenance" else cells[n]).alias(n) for n in names])
    p = files.read_tsv(spark, prompt_file)
    known = legacy_status | {v: v for v in legacy_status.values()}
    prompts = p.select(
        "concept_id", "concept_name", map_or_fail(F.split("concept_id", "-")[0], tier_by_prefix).alias("tier"), "species", "prompt_text", map_or_fail(F.col("species_status"), known).alias("species_status")
    )
    return Bank(concepts, prompts)
