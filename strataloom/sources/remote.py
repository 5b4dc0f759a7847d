"""Paged and batched sources behind an injected fetcher.

A fetcher is a function ``(path, parameters) -> (status, body)``: an HTTP client
in production, a replay of stored replies in tests.  What to ask is a table, one
row a request or a root, so requests spread over tasks, a lost executor repeats
only its own, and replies are rows that native expressions parse.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rate import TokenBucket, shares

Fetcher = Callable[[str, Mapping[str, str]], tuple[int, str]]

#: Statuses after which the same request may succeed (fixed values).
RETRYABLE = (429, 500, 502, 503, 504)
#: What an error text says about a key, about the rate, and a refusal about a licence (fixed values).
KEY_WORDS = ("api key", "apikey", "invalid key")
RATE_WORDS = ("rate limit", "too many requests")
LICENCE_WORDS = ("license", "licence", "licensed", "terms of use", "agreement", "subscribe")
REQUEST = "path string, params map<string,string>"


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def reply_error(status: Column, body: Column, licensed: Column | None = None) -> Column:
    """What is wrong with a reply, null if nothing is.

    Statuses come first; a reply of status 200 may hold an error document, whose
    text says what it is about; one that is cut off is malformed.  ``licensed``
    marks requests for a source under a licence, whose refusal is one of the
    licence.
    """
    def says(text: Column, words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(w) for w in words])

    refused = says(F.lower(body), LICENCE_WORDS) if licensed is None else says(F.lower(body), LICENCE_WORDS) | licensed
    embedded = F.lower(F.regexp_extract(body, r"(?s)<ERROR>(.*?)</ERROR>", 1))
    about_key, about_rate = says(embedded, KEY_WORDS), says(embedded, RATE_WORDS)
    return (
        F.when(status == 401, "authentication")
        .when((status == 403) & refused, "licence")
        .when(status == 403, "authentication")
        .when(status == 404, "not_found")
        .when(status == 429, "rate_limited")
        .when(status.isNull() | (status >= 400), "transient")
        .when(body.contains("<ERROR>") & about_key, "authentication")
        .when(body.contains("<ERROR>") & about_rate, "rate_limited")
        .when(body.contains("<ERROR>"), "malformed")
    )


def _ask(fetcher: Fetcher, path: str, params: Mapping[str, str], attempts: int, pause: float) -> tuple[int, str, int]:
    for attempt in range(1, attempts + 1):
        status, body = fetcher(path, params)
        if status not in RETRYABLE or attempt == attempts:
            return status, body, attempt
        time.sleep(pause * 2 ** (attempt - 1))
    raise ValueError("attempts must be at least 1")


def limited(fetcher: Fetcher, bucket: TokenBucket) -> Fetcher:
    """The fetcher, asked only when the bucket allows it; repeated requests count too."""

    def ask(path: str, params: Mapping[str, str]) -> tuple[int, str]:
        bucket.acquire()
        return fetcher(path, params)

    return ask


def fetch(requests: DataFrame, fetcher: Fetcher, attempts: int = 3, pause: float = 0.0, rate: float | None = None, burst: int = 1, tasks: int = 8) -> DataFrame:
    """``requests`` (path, params and other columns) with status, body and attempts.

    A status that may pass is asked again, up to ``attempts`` times.  With
    ``rate`` the requests are dealt to at most ``tasks`` tasks, each with its
    share of the rate and the burst, which all together keep.
    """
    if rate is not None:
        tasks, rate, burst = shares(rate, burst, tasks)
        requests = requests.repartition(tasks)
    schema = requests.select("*", F.lit(0).alias("status"), F.lit("").alias("body"), F.lit(0).alias("attempts")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = fetcher if rate is None else limited(fetcher, TokenBucket(rate, burst))
        for f in frames:
            got = [_ask(own, p, dict(q or {}), attempts, pause) for p, q in zip(f["path"], f["params"])]
            yield f.assign(status=[g[0] for g in got], body=[g[1] for g in got], attempts=[g[2] for g in got]).astype({"status": "int32", "attempts": "int32"})

    return requests.mapInPandas(run, schema)


def id_batches(ids: DataFrame, column: str, size: int, path: str, params: Mapping[str, str], tasks: int = 8) -> DataFrame:
    """Requests for the ids, up to ``size`` in each; nulls and repeats are left out."""
    own = ids.select(F.col(column).cast("string").alias("id")).where("id is not null").distinct().repartition(tasks, "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[str] = []
        for f in frames:
            waiting += f["id"].tolist()
            while len(waiting) >= size:
                yield pd.DataFrame({"path": [path], "params": [{**params, "id": ",".join(waiting[:size])}]})
                waiting = waiting[size:]
        if waiting:
            yield pd.DataFrame({"path": [path], "params": [{**params, "id": ",".join(waiting)}]})

    return own.mapInPandas(run, REQUEST)


def history_batches(spark: SparkSession, total: int, size: int, path: str, params: Mapping[str, str]) -> DataFrame:
    """Requests for results 0 to total - 1 of a stored search, ``size`` at a time."""
    fixed = F.create_map(*[F.lit(x) for kv in params.items() for x in kv]) if params else F.create_map().cast("map<string,string>")
    start = F.col("id") * size
    paged = F.create_map(F.lit("retstart"), start.cast("string"), F.lit("retmax"), F.least(F.lit(size), F.lit(total) - start).cast("string"))
    return spark.range(-(-total // size)).select(F.lit(path).alias("path"), F.map_concat(fixed, paged).alias("params"))


def follow_pages(roots: DataFrame, fetcher: Fetcher, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """(root, page, item): the items of all pages from each root on.

    ``roots`` has root, path and params.  A page is a JSON object with
    ``collection``; the next one is ``links.nextPage`` (a URL with its query),
    or ``page`` + 1 while ``page`` is below ``pageCount``.  A reply that is not
    of status 200 is an error, as is a page that leads back to one already read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for root, path, params in zip(f["root"], f["path"], f["params"]):
                rows = list(pages(root, path, dict(params or {}), fetcher, attempts, pause))
                yield pd.DataFrame(rows, columns=["root", "page", "item"]).astype({"page": "int32"})

    return roots.select(F.col("root").cast("string").alias("root"), "path", "params").mapInPandas(run, "root string, page int, item string")


def pages(root: str, path: str, params: dict, fetcher: Fetcher, attempts: int = 3, pause: float = 0.0) -> Iterator[tuple[str, int, str]]:
    """(root, page, item) of all pages from one request on, see ``follow_pages``."""
    ask, seen, number = (path, params), set(), 0
    while ask is not None:
        key = (ask[0], tuple(sorted(ask[1].items())))
        if key in seen:
            raise ValueError(f"pages of {root} go round in circles at {key}")
        seen.add(key)
        status, body, _ = _ask(fetcher, ask[0], ask[1], attempts, pause)
        if status != 200:
            raise OSError(f"status {status} for {ask[0]}")
        data, number = json.loads(body), number + 1
        for x in data.get("collection") or []:
            yield root, number, json.dumps(x, sort_keys=True)
        link, at = (data.get("links") or {}).get("nextPage"), int(data.get("page") or 1)
        if link:
            parts = urlsplit(link)
            ask = (parts.path, dict(parse_qsl(parts.query)))
        else:
            ask = (path, {**params, "page": str(at + 1)}) if at < int(data.get("pageCount") or 1) else None
