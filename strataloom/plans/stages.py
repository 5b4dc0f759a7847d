"""Chains of DataFrame stages with stored results and resume."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import exists


@dataclass(frozen=True)
class ViewConfig:
    """Thresholds of the matching and filtering stages; checked when made."""

    within: float = 0.85
    across: float = 0.92
    near: float = 0.70
    keep: float = 0.55
    drop: float = 0.35
    neighbours: int = 10

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name == "neighbours" and v < 1 or f.name != "neighbours" and not -1 <= v <= 1:
                raise ValueError(f"{f.name} is out of range: {v}")
        if self.drop > self.keep:
            raise ValueError("drop is above keep")

    @classmethod
    def of(cls, values: dict) -> ViewConfig:
        """From a mapping; unknown keys are an error."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[DataFrame], DataFrame]
    #: Schema the result must have (DDL); None leaves it as it is.
    schema: str | None = None


def run_stages(spark: SparkSession, start: DataFrame, stages: Sequence[Stage], folder: str, resume_from: str | None = None) -> DataFrame:
    """Run the stages in order, each result stored under ``folder/name``.

    With ``resume_from`` stages before that one are read from their stored
    results; a missing one is an error.  A stage's result replaces an older one.
    """
    from ..operators.checks import to_schema

    names = [s.name for s in stages]
    if len(set(names)) != len(names):
        raise ValueError("stage names repeat")
    first = names.index(resume_from) if resume_from is not None else 0
    df = start
    if first:
        path = f"{folder}/{names[first - 1]}"
        if not exists(spark, path):
            raise FileNotFoundError(path)
        df = spark.read.parquet(path)
    for s in stages[first:]:
        out = s.run(df)
        out = to_schema(out, s.schema) if s.schema else out
        out.write.mode("overwrite").parquet(f"{folder}/{s.name}")
        df = spark.read.parquet(f"{folder}/{s.name}")
    return df
