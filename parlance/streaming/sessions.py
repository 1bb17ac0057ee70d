"""Keyed sessions over live events, as one stateful operator with a batch twin.

A speaker's voice frames make segments. A segment ends after a pause; the pause allowed is short once
enough has been said and long before that, so it depends on what the segment holds already. Where it
would get too long it is cut at its quietest frame near the end, and the next one begins a little
before the cut. The same fold runs over the rows of a key in a batch and over the state of a key in a
stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key long, segment long, start_ms long, end_ms long, frames long, energy double, overlaps boolean, is_final boolean"
STATE = "segment long, start_ms long, last_voice_ms long, last_end_ms long, preview_ms long, overlaps boolean, ms array<long>, energy array<double>"


@dataclass(frozen=True)
class Pauses:
    """Milliseconds, and the least mean energy of a frame that counts as voice.

    ``short`` ends a segment that holds ``enough``, ``long`` one that holds less; ``most`` and ``least`` bound its
    length; previews come every ``preview``, ``overlap`` is said again after a cut, which is looked for in the last
    ``search``; of a pause inside a segment ``kept`` at most is kept as silence.
    """

    short: int = 700
    enough: int = 3000
    long: int = 2500
    most: int = 20000
    least: int = 700
    quiet: float = 0.0015
    preview: int = 3000
    overlap: int = 600
    search: int = 500
    kept: int = 1000


class Segmenter:
    """Folds frames (at, milliseconds, energy) in time order into segments: previews under the number of the final one, and finals."""

    def __init__(self, pauses: Pauses, state: tuple | None = None):
        self.pauses = pauses
        self.segment, self.start, self.voice, self.end, self.preview, self.overlaps, ms, energy = state or (0, None, None, None, 0, False, [], [])
        self.ms, self.energy = list(ms), list(energy)
        self.held = sum(self.ms)

    @property
    def state(self) -> tuple:
        return self.segment, self.start, self.voice, self.end, self.preview, self.overlaps, self.ms, self.energy

    def _first_preview(self) -> int:
        return max(self.pauses.enough, self.pauses.least, 1000)

    def _made(self, end: int, n: int, is_final: bool) -> Iterator[tuple]:
        """The first ``n`` frames as a segment; those too short or too quiet give nothing."""
        ms = sum(self.ms[:n])
        if n and ms >= self.pauses.least and sum(e * m for e, m in zip(self.energy[:n], self.ms[:n], strict=True)) / ms >= self.pauses.quiet:
            yield self.segment, self.start, end, n, sum(self.energy[:n]), self.overlaps, is_final

    def is_done(self, now: int) -> bool:
        return self.start is not None and now - self.voice >= (self.pauses.short if self.held >= self.pauses.enough else self.pauses.long)

    def add(self, at: int, ms: int, energy: float) -> Iterator[tuple]:
        """Frames that begin before the open segment, which a cut may have moved on, are late and dropped."""
        if ms <= 0 or (self.start is not None and at < self.start):
            return
        if self.is_done(at):
            yield from self.close()
        if self.start is None:
            self.start, self.end, self.preview, self.overlaps, self.ms, self.energy, self.held = at, at, self._first_preview(), False, [], [], 0
        if at > self.end:
            self._hold(min(at - self.end, self.pauses.kept), 0.0)
        self._hold(ms, energy)
        self.voice = self.end = max(at + ms, self.end)
        while self.held >= self.pauses.most:
            before = self.held
            yield from self._cut()
            if self.held >= before:
                break
        if self.held >= self.preview:
            yield from self._made(self.voice, len(self.ms), False)
            self.preview = self.held + self.pauses.preview

    def _hold(self, ms: int, energy: float) -> None:
        self.ms.append(ms)
        self.energy.append(energy)
        self.held += ms

    def _cut(self) -> Iterator[tuple]:
        """End the segment after its quietest frame, of several the first, among those of the last ``search`` before ``most``."""
        ends, total = [], 0
        for ms in self.ms:
            total += ms
            ends.append(total)
        last = max([i for i, e in enumerate(ends) if e <= self.pauses.most], default=0)
        near = [i for i in range(last + 1) if ends[i] - self.ms[i] >= ends[last] - self.pauses.search] or [last]
        split = min(near, key=lambda i: (self.energy[i], i)) + 1
        yield from self._made(self.start + ends[split - 1], split, True)
        again = split
        while again > 0 and ends[split - 1] - (ends[again - 2] if again > 1 else 0) <= self.pauses.overlap:
            again -= 1
        said = ends[again - 1] if again else 0
        if not again:  # one long frame: nothing is said again
            again, said = split, ends[split - 1]
        self.segment, self.start, self.overlaps, self.preview = self.segment + 1, self.start + said, True, self._first_preview()
        self.ms, self.energy, self.held = self.ms[again:], self.energy[again:], self.held - said

    def close(self) -> Iterator[tuple]:
        """End the open segment at its last voice; it takes a number even if it gives nothing."""
        if self.start is not None:
            yield from self._made(self.voice, len(self.ms), True)
            self.segment, self.start, self.voice, self.end, self.ms, self.energy, self.held = self.segment + 1, None, None, None, [], [], 0


COLUMNS = ["key", "segment", "start_ms", "end_ms", "frames", "energy", "overlaps", "is_final"]


def batch_segments(frames: DataFrame, pauses: Pauses = Pauses(), previews: bool = False) -> DataFrame:
    """Segments of frames (key, at_ms, ms, energy): each key's rows are sorted by Spark and read one batch after another.

    A key is never held as a whole: partitions are sorted by key and time, and the fold goes through
    them. A frame of length 0 is the key's leave event if its energy is null. Rows with a null in key or
    time are left out; a null length is 0.
    """
    clean = frames.select("key", "at_ms", F.coalesce("ms", F.lit(0)).alias("ms"), "energy").filter("key IS NOT NULL AND at_ms IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None
        for batch in batches:
            out = []
            for k, at, ms, energy in zip(batch["key"].tolist(), batch["at_ms"].tolist(), batch["ms"].tolist(), batch["energy"].tolist(), strict=True):
                if k != key:
                    if fold is not None:
                        out += [(key, *s) for s in fold.close()]
                    key, fold = k, Segmenter(pauses)
                out += [(key, *s) for s in (fold.close() if ms == 0 and pd.isna(energy) else fold.add(at, ms, 0.0 if pd.isna(energy) else energy))]
            yield pd.DataFrame(out, columns=COLUMNS)
        if fold is not None:
            yield pd.DataFrame([(key, *s) for s in fold.close()], columns=COLUMNS)

    made = clean.repartition("key").sortWithinPartitions("key", "at_ms", "ms", "energy").mapInPandas(run, OUTPUT)
    return made if previews else made.filter("is_final")


def stream_segments(frames: DataFrame, pauses: Pauses = Pauses(), idle_ms: int = 50_000) -> DataFrame:
    """The same over a stream, previews too; frames of a micro-batch are put in order, and ``idle_ms`` without any ends a key.

    A leave event (length 0, null energy) ends a key at once.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Segmenter(pauses, tuple(x if hasattr(x, "__len__") else None if pd.isna(x) else x for x in state.get) if state.exists else None)
        if state.hasTimedOut:
            out = list(fold.close())
            state.remove()
        else:
            rows = sorted((at, ms, -1.0 if ms == 0 and pd.isna(energy) else 0.0 if pd.isna(energy) else energy) for b in batches for at, ms, energy in zip(b["at_ms"].tolist(), b["ms"].tolist(), b["energy"].tolist(), strict=True))
            out = []
            for at, ms, energy in rows:
                if energy < 0:
                    out += fold.close()
                else:
                    out += fold.add(at, ms, energy)
            state.update(fold.state)
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *s) for s in out], columns=COLUMNS)

    return frames.groupBy("key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def settled(segments: DataFrame, order: str) -> DataFrame:
    """One row of each (key, segment): its final if there is one, whatever came after it, else the latest preview.

    ``order`` is the arrival. This is how previews are retracted and late ones suppressed.
    """
    rest = [c for c in segments.columns if c not in ("key", "segment")]
    best = segments.groupBy("key", "segment").agg(F.max_by(F.struct(*rest), F.struct("is_final", order)).alias("_best"))
    return best.select("key", "segment", "_best.*")


def frames_of(events: DataFrame) -> DataFrame:
    """Voice events as frames: a second for each unit of value."""
    return events.select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.round(F.col("value") * 1000).cast("long").alias("ms"), F.col("value").cast("double").alias("energy"))
