"""Joins of the library: audience, neighbours, first match, rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import ascii_key, folded


def for_audience(rows: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """Rows whose id the audience may see. Spark broadcasts the ids if they are few enough."""
    return rows.join(visible.select(key), key, "left_semi")


def neighbours(links: DataFrame, seeds: DataFrame, visible: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, shared): what shares most links with the seeds, among what is visible and no seed.

    Links of the seeds are counted by (kind, key) first, so a link that very many share is one row.
    """
    wanted = links.join(seeds, "doc_id", "left_semi").groupBy("kind", "key").agg(F.count("*").alias("seeds"))
    others = links.join(seeds, "doc_id", "left_anti").join(visible, "doc_id", "left_semi")
    shared = others.join(wanted, ["kind", "key"]).groupBy("doc_id").agg(F.sum("seeds").alias("shared"))
    return shared.orderBy(F.desc("shared"), "doc_id").limit(most)


def pending(passages: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """Passages that have no vector yet."""
    return passages.join(embedded.select(key), key, "left_anti")


def first_speaker(tasks: DataFrame, speakers: DataFrame, assignee: str, task: str, order: str = "speaker_no") -> DataFrame:
    """Tasks with the first speaker whose display name or username is the assignee, A-Z as a-z; else null.

    Either name is one row of an equi-join, so there is no join by OR.
    """
    names = speakers.select(F.explode(F.array_distinct(F.array(ascii_key(F.col("display_name")), ascii_key(F.col("username"))))).alias("_name"), F.struct(order, "display_name").alias("_speaker"))
    best = names.groupBy("_name").agg(F.min("_speaker").alias("_speaker"))
    return tasks.join(best, ascii_key(F.col(assignee)) == F.col("_name"), "left").select(*tasks.columns, F.col("_speaker.display_name").alias("speaker"))


def with_default_name(rows: DataFrame, names: DataFrame, key: str, name: str, default: Column) -> DataFrame:
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(name, default))


def merged_roster(page: DataFrame, protocol: DataFrame, inactive: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of both rosters; the protocol's value wins, and what only the page has stays unless it is inactive."""
    p, q = page.select(key, F.col(value).alias("_page")), protocol.select(key, F.col(value).alias("_protocol"))
    both = p.join(q, key, "full_outer").join(inactive.select(key).withColumn("_gone", F.lit(True)), key, "left")
    return both.filter("_protocol IS NOT NULL OR _gone IS NULL").select(key, F.coalesce("_protocol", "_page").alias(value), F.when(F.col("_protocol").isNotNull(), "protocol").otherwise("page").alias("origin"))


def live_over_stored(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return live.unionByName(stored.join(live.select(key), key, "left_anti"))


def synced(store: DataFrame, index: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, status): indexed, unchanged or removed, by comparing fingerprints of the store with those of the index."""
    s, i = store.select(key, F.col(fingerprint).alias("_new")), index.select(key, F.col(fingerprint).alias("_old"))
    both = s.join(i, key, "full_outer")
    return both.select(key, F.when(F.col("_new").isNull(), "removed").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("indexed").alias("status"))


def subscribed(meetings: DataFrame, subscriptions: DataFrame, guild: str, channel: str) -> DataFrame:
    """Meetings with each subscription that takes them: scope "all", or the one guild and channel of another scope.

    Two equi-joins, not one by OR: every meeting meets the "all" list, which is configuration, by a constant.
    """
    everything = subscriptions.filter("scope = 'all'").select("name", F.lit(1).alias("_one"))
    some = subscriptions.filter("scope <> 'all'").select("name", F.col("guild").alias(guild), F.col("channel").alias(channel))
    by_all = meetings.select("*", F.explode(F.array(F.lit(1))).alias("_one")).join(everything, "_one").drop("_one")
    return by_all.unionByName(meetings.join(some, [guild, channel]).select(*meetings.columns, "name"))


def visible_meetings(meetings: DataFrame, attendance: DataFrame, guild: object | None = None, speaker: object | None = None) -> DataFrame:
    """All meetings, or for a guild and speaker those that are attributable, of that guild, and attended, silently or not."""
    if guild is None:
        return meetings
    mine = attendance.filter(F.col("speaker_id") == speaker).select("id")
    return meetings.filter(F.col("attributable") & (F.col("guild_id") == guild)).join(mine, "id", "left_semi")


def canonical_name(tasks: DataFrame, speakers: DataFrame, assignee: str) -> DataFrame:
    """Tasks with the assignee as the first speaker's display name whose display name or username folds to the same; others stay."""
    names = speakers.select(F.explode(F.array(folded(F.col("display_name")), folded(F.col("username")))).alias("_name"), F.struct("speaker_no", "display_name").alias("_speaker")).filter("_name <> ''")
    best = names.groupBy("_name").agg(F.min("_speaker").alias("_speaker"))
    joined = tasks.join(best, folded(F.col(assignee)) == F.col("_name"), "left")
    return joined.withColumn(assignee, F.coalesce("_speaker.display_name", assignee)).select(*tasks.columns)


def resolved(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose source is known, with what is known of it; others drop out. ``rows`` may be a stream."""
    return rows.join(owners, key)


def first_spelling(names: DataFrame, name: str, place: str) -> DataFrame:
    """(key, name): each name once whatever its case, blanks left out, in the spelling that comes first."""
    return names.filter(F.trim(name) != "").groupBy(F.lower(name).alias("key")).agg(F.min_by(name, F.struct(place, name)).alias(name))
