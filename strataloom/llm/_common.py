"""Shared plumbing: intermediate tables, parts of texts, row keys."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import SLICE_BYTES, SLICE_ROWS, append_columns, slices, small_batches  # noqa: F401
from ..storage import discard, fresh_path, shared_folder, stored  # noqa: F401

#: Characters of a long text that are worked on at a time.
PART = 1 << 20

#: White space in the sense of the word pattern ``[^\x20\x09-\x0D]+``.
ASCII_SPACE = " \t\n\r\x0b\x0c"
_SPACE = re.compile(f"[{ASCII_SPACE}]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_parts(text: str | None, size: int = PART):
    """The text in parts of about ``size`` characters, cut before white space.

    The parts put together are the text.  A word that is longer than ``size``
    stays whole; a null text is one empty part.
    """
    text, at = text or "", 0
    while len(text) - at > size and (m := _SPACE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has (case-insensitively)."""
    taken = {c.lower() for df in frames for c in df.columns}
    names = itertools.chain([base], (f"{base}_{i}" for i in itertools.count(1)))
    return next(n for n in names if n.lower() not in taken)


def without(df: DataFrame, new: list[str], needed: list[str]) -> DataFrame:
    """``df`` without columns that new ones of these names replace; an error if one of them is needed."""
    taken = {n.lower() for n in new}
    if clash := sorted(n for n in needed if n.lower() in taken):
        raise ValueError(f"{clash} cannot be replaced, they are read")
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def remainder(id_column: str, modulus: int):
    """``crc32(id as text) mod modulus``; null for a null id."""
    return F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % F.lit(modulus)
