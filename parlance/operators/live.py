"""Live state folded from events in their order: clocks, rosters, channels and routes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tick_clock(rows: DataFrame, session: str, order: list[str], tick_ms: int = 20) -> DataFrame:
    """``rows`` with now_ms: time counts what was heard, not what passed, so it never runs ahead of the audio."""
    return rows.withColumn("now_ms", (F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1) * tick_ms)


def until_ending(rows: DataFrame, session: str, order: list[str], ending: Column) -> DataFrame:
    """Rows of each session up to the one that ends it; what comes later is late and dropped."""
    first = rows.filter(ending).groupBy(session).agg(F.min(F.struct(*order)).alias("_ending"))
    return rows.join(first, session, "left").filter(F.col("_ending").isNull() | (F.struct(*order) <= F.col("_ending"))).drop("_ending")


def departures(rows: DataFrame, snapshot: str, person: str, sure: str) -> DataFrame:
    """(snapshot, person) of those who were in the snapshot before and are not in this one, among snapshots that are sure.

    A snapshot is sure if one of its rows is. The list of snapshots is small; people are joined by equality.
    """
    there = rows.groupBy(snapshot, person).agg(F.bool_or(sure).alias("_sure"))
    snapshots = there.groupBy(snapshot).agg(F.bool_or("_sure").alias("_sure")).filter("_sure").select(snapshot)
    steps = snapshots.withColumn("_next", F.lead(snapshot).over(Window.orderBy(snapshot))).filter("_next IS NOT NULL")
    before = there.join(steps, snapshot).select(F.col("_next").alias(snapshot), person)
    return before.join(there.select(snapshot, person), [snapshot, person], "left_anti")


def channel_owners(rows: DataFrame, channel: str, owner: str, leaves: str, order: list[str]) -> DataFrame:
    """(channel, owner) after all rows: the last to bind owns it, unless it left later; departures of others are stale."""
    bound = rows.filter(~F.col(leaves)).groupBy(channel).agg(F.max_by(F.struct(F.col(owner).alias("owner"), F.struct(*order).alias("at")), F.struct(*order)).alias("_b")).select(channel, F.col("_b.owner").alias(owner), F.col("_b.at").alias("_at"))
    gone = rows.filter(leaves).groupBy(channel, owner).agg(F.max(F.struct(*order)).alias("_gone"))
    return bound.join(gone, [channel, owner], "left").filter(F.col("_gone").isNull() | (F.col("_gone") < F.col("_at"))).select(channel, owner)


def route_owner(protocol: Column, current: Column, activity: Column, overridden: Column, stale: Column) -> Column:
    """Whose a route is: activity overrides the protocol while that is absent, stale or the one overridden; else the protocol, or the owner so far if it is stale."""
    overrides = (activity != "") & ((protocol == "") | stale | ((overridden != "") & (protocol == overridden)))
    return F.when(overrides, activity).when(protocol != "", protocol).when(stale, current).otherwise("")


def outputs_by_stream(rows: DataFrame, device: str, stream: str, at: str) -> DataFrame:
    """(stream, device): the latest stream of each device, and of each such stream the device that came last."""
    latest = rows.groupBy(device).agg(F.max_by(stream, at).alias(stream), F.max(at).alias(at))
    return latest.groupBy(stream).agg(F.max_by(device, at).alias(device))


def promoted(rows: DataFrame, session: str, mixed: Column, own: Column) -> DataFrame:
    """``rows``, mixed ones only of sessions that never had rows of their own."""
    some = rows.filter(own).select(session).distinct().withColumn("_own", F.lit(True))
    return rows.join(some, session, "left").filter(~mixed | F.col("_own").isNull()).drop("_own")


def stable_channels(rows: DataFrame, device: str, source: str, order: str) -> DataFrame:
    """(source, device, channel): each device keeps the channel it got when it was first met, numbered in that order.

    There is one row for each device; numbering them is the only step in one task.
    """
    first = rows.groupBy(device).agg(F.min_by(source, order).alias(source), F.min(order).alias("_first"))
    return first.withColumn("channel", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long")).select(source, device, "channel")


def rebound(rows: DataFrame, channel: str, row_id: str, person: str, order: list[str], votes: int = 3, most_held: int = 16) -> DataFrame:
    """(channel, row_id, held, owner): whose each row of a channel is when one active person at a time is a vote.

    ``person`` is null where not exactly one is active: such a row goes out if the channel has an owner. A
    vote for the owner clears the others; ``votes`` for another in a row, not counting rows without one,
    make that one the owner. Until then rows are held and belong to the next owner (null if there is none);
    with ``most_held`` of them the track itself becomes the owner for the time being. Rows without a
    channel are left out. Partitions are sorted by Spark, and the fold holds a few values of one channel.
    """
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (channel, row_id))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = owner = voter = None
        count = held = nth = 0
        for batch in batches:
            out = []
            for at, row, who in zip(batch[channel].tolist(), batch[row_id].tolist(), batch[person].tolist(), strict=True):
                if at != now:
                    now, owner, voter, count, held, nth = at, None, None, 0, 0, 0
                bound = None
                if pd.isna(who):
                    sent = owner is not None
                elif who == owner:
                    sent, voter, count = True, None, 0
                else:
                    voter, count = who, count + 1 if who == voter else 1
                    sent = count >= votes
                    if sent:
                        bound, voter, count = who, None, 0
                held += not sent
                if held >= most_held and not bound and owner != f"track:{at}":
                    bound = f"track:{at}"
                if bound:
                    owner, held = bound, 0
                nth += 1
                out.append((at, row, nth, not sent, bound))
            yield pd.DataFrame(out, columns=[channel, row_id, "_nth", "held", "_bound"])

    clean = rows.filter(F.col(channel).isNotNull()).select(channel, row_id, F.col(person).cast("string").alias(person), *[c for c in order if c not in (channel, row_id, person)])
    folded = clean.repartition(channel).sortWithinPartitions(channel, *order).select(channel, row_id, person).mapInPandas(run, f"{kinds}, _nth long, held boolean, _bound string")
    w = Window.partitionBy(channel).orderBy("_nth")
    next_one = F.first("_bound", True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return folded.select(channel, row_id, "held", F.when(F.col("held"), next_one).otherwise(F.last("_bound", True).over(w)).alias("owner"))
