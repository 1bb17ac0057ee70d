"""State by key with timers in event time: one fold, run over a batch or over a stream.

A fold takes the rows of a key in the order of their time, says when it wants to be woken next, and is
woken before any row of that time or later. Over a batch Spark sorts the rows of each key; over a stream
rows wait in a list state until the watermark has passed them, so late rows within the watermark's delay
take their place, and timers fire as the watermark passes them. Both therefore give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Fold:
    """What becomes of the rows of one key. ``state`` holds JSON values by name, and nothing else is kept."""

    def __init__(self, state: dict[str, Any] | None = None):
        self.state: dict[str, Any] = state if state is not None else {}

    def add(self, row: Any) -> Iterator[tuple]:
        """Rows to give for a row, which has at_ms and the other columns."""
        yield from ()

    def due(self) -> int | None:
        """When to be woken, in milliseconds; None: not at all."""
        return None

    def wake(self, at_ms: int) -> Iterator[tuple]:
        """Rows to give at the time that due() named. It must name another one afterwards, or none."""
        yield from ()


def _through(fold: Fold, rows: Iterator[Any], until: float) -> Iterator[tuple]:
    """The fold over rows in order, and its wakings up to ``until``."""
    for row in rows:
        while (due := fold.due()) is not None and due <= row.at_ms:
            yield from fold.wake(due)
        yield from fold.add(row)
    while (due := fold.due()) is not None and due <= until:
        yield from fold.wake(due)


def _named(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def batch_fold(rows: DataFrame, make: Callable[..., Fold], order: list[str], output: str, key: str = "key", ends: bool = True) -> DataFrame:
    """What the fold gives for rows (key, at_ms, others): (key, then ``output``).

    Rows of a key are sorted by at_ms and ``order``; a key's rows are read batch by batch and never held as
    a whole. With ``ends`` time goes on for ever after the last row, so all timers fire. Rows with a null
    in key or time are left out.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {output}"
    names, until = _named(schema), float("inf") if ends else float("-inf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if fold is None or k != now:
                    if fold is not None:
                        out += [(now, *x) for x in _through(fold, iter(()), until)]
                    now, fold = k, make()
                out += [(k, *x) for x in _through(fold, iter((row,)), float("-inf"))]
            yield pd.DataFrame(out, columns=names)
        if fold is not None:
            yield pd.DataFrame([(now, *x) for x in _through(fold, iter(()), until)], columns=names)

    clean = rows.filter(F.col(key).isNotNull() & F.col("at_ms").isNotNull())
    return clean.repartition(key).sortWithinPartitions(key, "at_ms", *order).mapInPandas(run, schema)


class _Processor(StatefulProcessor):
    def __init__(self, make: Callable[..., Fold], columns: list[str], kinds: str, order: list[str], names: list[str]):
        self.make, self.columns, self.kinds, self.order, self.names = make, columns, kinds, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)
        self.kept = handle.getMapState("kept", "name string", "value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            found = list(batch[self.columns].itertuples(index=False, name=None))
            if found:
                self.waiting.appendList(found)
                least = min(int(r[0]) for r in found)
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame([], columns=self.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=self.columns) if self.waiting.exists() else pd.DataFrame([], columns=self.columns)
        ready = rows[rows["at_ms"] <= passed].sort_values(["at_ms", *self.order], kind="stable")
        rest = rows[rows["at_ms"] > passed]
        before = {k[0]: v[0] for k, v in self.kept.iterator()} if self.kept.exists() else {}
        fold = self.make({k: json.loads(v) for k, v in before.items()})
        out = [(key[0], *x) for x in _through(fold, ready.itertuples(index=False), passed)]
        # Only what has changed is written.
        after = {k: json.dumps(v) for k, v in fold.state.items()}
        for name in before.keys() - after.keys():
            self.kept.removeKey((name,))
        for name, value in after.items():
            if before.get(name) != value:
                self.kept.updateValue((name,), (value,))
        if len(ready) and len(rest):
            self.waiting.put(list(rest.itertuples(index=False, name=None)))
        elif len(ready):
            self.waiting.clear()
        wakings = [int(t) for t in [rest["at_ms"].min() if len(rest) else None, fold.due()] if t is not None]
        if wakings:
            self.handle.registerTimer(min(wakings))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stream_fold(rows: DataFrame, make: Callable[..., Fold], order: list[str], output: str, delay: str, key: str = "key") -> DataFrame:
    """batch_fold() over a stream, for rows that are late by ``delay`` at most; others are dropped.

    State is kept by key: a list of the rows that wait for the watermark, and a map of the fold's values,
    of which only those that change are written. The session's state store must be RocksDB.
    """
    kind = rows.schema[key].dataType.simpleString()
    columns = ["at_ms", *(c for c in rows.columns if c not in (key, "at_ms"))]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    schema = f"{key} {kind}, {output}"
    clean = rows.filter(F.col(key).isNotNull() & F.col("at_ms").isNotNull()).withColumn("_at", F.timestamp_millis("at_ms")).withWatermark("_at", delay)
    return clean.groupBy(key).transformWithStateInPandas(_Processor(make, columns, kinds, order, _named(schema)), schema, "append", "eventTime")
