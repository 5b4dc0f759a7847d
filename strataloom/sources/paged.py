"""Paged services as a data source: ``spark.read.format("paged_service")``.

Options: ``fetcher`` (``module:function``, see ``remote``), and either ``roots``
(JSON: a list of [root, path, parameters]) whose pages are followed, or ``path``,
``total``, ``size`` and ``params`` (JSON) for the results of a stored search.  A
root, or ``batches`` requests of a search, is a partition.  ``rate`` and ``burst``
bound the requests of all partitions together; ``attempts`` and ``pause`` are
those of ``remote.fetch``.  Equality and ``in`` on ``root`` choose the partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import rate as rt
from . import remote

NAME = "paged_service"


@dataclass
class Part(InputPartition):
    """A root and its first request, or a range of a search's requests."""

    root: str
    path: str
    params: dict
    first: int = 0
    stop: int = 0
    rate: float | None = None
    burst: float = 1.0


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        module, _, name = options["fetcher"].partition(":")
        self.fetcher_name = (module, name)
        self.attempts, self.pause = int(options.get("attempts", 3)), float(options.get("pause", 0))
        self.rate, self.burst = options.get("rate"), int(options.get("burst", 1))
        self.size = int(options.get("size", 0))
        if "roots" in options:
            self.parts = [Part(str(r), p, dict(q or {})) for r, p, q in json.loads(options["roots"])]
        else:
            total, step = int(options["total"]), int(options.get("batches", 16)) * self.size
            params = json.loads(options.get("params", "{}"))
            self.parts = [Part(options["path"], options["path"], params, at, min(total, at + step)) for at in range(0, total, step)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("root",):
                self.parts = [p for p in self.parts if p.root == f.value]
            elif isinstance(f, In) and f.attribute == ("root",):
                self.parts = [p for p in self.parts if p.root in f.value]
            else:
                yield f

    def partitions(self) -> list[Part]:
        if self.rate is None:
            return self.parts
        # No more partitions than the burst has requests, so all together keep within it.
        n, each, burst = rt.shares(float(self.rate), self.burst, len(self.parts))
        if n < len(self.parts):
            raise ValueError(f"{len(self.parts)} partitions need a burst of as many requests, or no rate")
        return [Part(p.root, p.path, p.params, p.first, p.stop, each, burst) for p in self.parts]

    def read(self, partition: Part) -> Iterator[tuple]:
        fetcher = getattr(import_module(self.fetcher_name[0]), self.fetcher_name[1])
        if partition.rate is not None:
            fetcher = remote.limited(fetcher, rt.TokenBucket(partition.rate, partition.burst))
        if not partition.stop:
            yield from remote.pages(partition.root, partition.path, partition.params, fetcher, self.attempts, self.pause)
            return
        for number, at in enumerate(range(partition.first, partition.stop, self.size), partition.first // self.size + 1):
            params = {**partition.params, "retstart": str(at), "retmax": str(min(self.size, partition.stop - at))}
            status, body, _ = remote._ask(fetcher, partition.path, params, self.attempts, self.pause)
            if status != 200:
                raise OSError(f"status {status} for {partition.path}")
            yield partition.root, number, body


class PagedService(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "root string, page int, item string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedService)
