"""Streaming forms of batch operators (an extension: the batch forms come first)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) per key and window; rows later than the watermark are left out."""
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    out = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), key, "n", *(["total"] if value else []))


def running_best(events: DataFrame, key: str, step: str, value: str, delta: float) -> DataFrame:
    """Accepted improvements per key, kept across micro-batches.

    The state is the last accepted value of a key.  Within a micro-batch steps
    are taken in order; a step that arrives in a later batch than its
    successors is judged when it arrives.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def fold(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        rows = []
        data = pd.concat(list(batches)).dropna(subset=[value]).sort_values(step, kind="stable")
        for s, v in zip(data[step], data[value]):
            if best is None or v < best - delta:
                best = float(v)
                rows.append((k[0], s, v))
        if best is not None:
            state.update((best,))
        yield pd.DataFrame(rows, columns=[key, step, value])

    return events.select(key, step, value).groupBy(key).applyInPandasWithState(
        fold, f"{key} {kinds[key]}, {step} {kinds[step]}, {value} {kinds[value]}", "best double", "append", "NoTimeout"
    )


class _Judge(StatefulProcessor):
    """Holds steps until the watermark has passed them, then judges them in order."""

    def __init__(self, names: tuple[str, str, str, str], kind: str, delta: float):
        self.names, self.kind, self.delta = names, kind, delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "value double")
        self.waiting = handle.getListState("waiting", f"at bigint, step {self.kind}, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, step, value, time = self.names
        new = []
        for f in rows:
            f = f.dropna(subset=[value])
            at = f[time].astype("datetime64[ms]").astype("int64")
            new += [(int(a), s, float(v)) for a, s, v in zip(at, f[step], f[value])]
        if new:
            self.waiting.appendList(new)
            # The timer is due when the watermark reaches the first of them.
            self.handle.registerTimer(min(a for a, _, _ in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted((r for r in held if r[0] < reached), key=lambda r: (r[1], r[0]))
        rest = [r for r in held if r[0] >= reached]
        best = self.best.get()[0] if self.best.exists() else None
        out = []
        for _, s, v in due:
            if best is None or v < best - self.delta:
                best = v
                out.append((key[0], s, v))
        if best is not None:
            self.best.update((best,))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) + 1)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=list(self.names[:3]), dtype=object)

    def close(self) -> None:
        pass


def settled_best(events: DataFrame, key: str, step: str, value: str, time: str, delta: float, late: str = "10 minutes") -> DataFrame:
    """Accepted improvements per key in the order of steps, whatever the order they arrive in.

    A step waits in the state until the watermark, ``late`` behind the newest
    event time, has passed its time; then it and all before it are judged in the
    order of ``step``, which has to agree with that of ``time``.  So the result
    is that of ``ranking.running_best`` on all rows that are not later than the
    watermark.  State of a key is its last accepted value and the steps that
    wait.  The session needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    judge = _Judge((key, step, value, time), kinds[step], delta)
    own = events.select(key, step, F.col(value).cast("double").alias(value), time).withWatermark(time, late)
    schema = f"{key} {kinds[key]}, {step} {kinds[step]}, {value} double"
    return own.groupBy(key).transformWithStateInPandas(judge, schema, "Append", "EventTime")
