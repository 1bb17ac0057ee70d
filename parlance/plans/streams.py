"""Queries of live state over the driver's events: clocks, rosters, routes, retraction. A session is a user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import values as v
from parlance.operators import live
from parlance.plans.queries import query
from parlance.sources.tables import read
from parlance.streaming import sessions


def told(spark, d):
    """Events in their order of arrival."""
    return read(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 20 AS now_ms FROM events")
def str_1_tick_clock(spark, d):
    return live.tick_clock(told(spark, d), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id", "now_ms")


@query()
def str_3_forced_cuts(spark, d):
    frames = sessions.frames_of(told(spark, d))
    return sessions.batch_segments(frames, sessions.Pauses(short=3_600_000, enough=60_000, long=86_400_000, most=300_000, search=60_000, overlap=60_000))


@query()
def str_4_previews(spark, d):
    frames = sessions.frames_of(told(spark, d))
    made = sessions.batch_segments(frames, sessions.Pauses(short=3_600_000, enough=60_000, long=86_400_000, most=300_000, preview=60_000), previews=True)
    return made.groupBy("key", "segment").agg(F.count_if(~F.col("is_final")).alias("previews"), F.count_if("is_final").alias("finals"))


@query("SELECT user_id AS key, event_type AS segment, arg_max(event_id, (value > 50, event_id)) AS event_id, bool_or(value > 50) AS is_final FROM events GROUP BY ALL")
def str_7_retracted(spark, d):
    said = told(spark, d).select(F.col("user_id").alias("key"), F.col("event_type").alias("segment"), "event_id", (F.col("value") > 50).alias("is_final"))
    return sessions.settled(said, "event_id")


@query("SELECT event_id FROM events e LEFT JOIN (SELECT user_id, min((ts, event_id)) AS ending FROM events WHERE event_type = 'signup' GROUP BY 1) x ON x.user_id = e.user_id WHERE ending IS NULL OR (e.ts, e.event_id) <= ending")
def str_9_late_dropped(spark, d):
    return live.until_ending(told(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "signup").select("event_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS place FROM events")
def str_10_resorted(spark, d):
    return told(spark, d).select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")).alias("place"))


@query("""WITH s AS (SELECT DISTINCT ts::DATE AS day, user_id, event_type = 'error' AS unsure FROM events), a AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT day FROM s GROUP BY day HAVING NOT bool_and(unsure)))
SELECT a.day, p.user_id FROM a JOIN a b ON b.n = a.n - 1 JOIN (SELECT DISTINCT day, user_id FROM s) p ON p.day = b.day WHERE (a.day, p.user_id) NOT IN (SELECT (day, user_id) FROM s)""")
def str_13_departures(spark, d):
    rows = told(spark, d).select(F.to_date("ts").alias("day"), "user_id", (F.col("event_type") != "error").alias("sure"))
    return live.departures(rows, "day", "user_id", "sure")


@query("WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) SELECT event_type AS channel, user_id AS owner FROM l WHERE nth = 1")
def str_14_rebound_channels(spark, d):
    # A departure that names another than the owner is stale and changes nothing.
    binds = told(spark, d).select(F.col("event_type").alias("channel"), F.col("user_id").alias("owner"), "ts", "event_id", F.lit(False).alias("leaves"))
    stale = binds.withColumn("leaves", F.lit(True)).withColumn("owner", F.col("owner") + 1_000_000)
    return live.channel_owners(binds.unionByName(stale), "channel", "owner", "leaves", ["ts", "event_id"])


@query("SELECT event_id, CASE WHEN value > 30 AND (event_type = 'click' OR value < 60) THEN 'activity' WHEN event_type <> 'click' THEN 'protocol' ELSE '' END AS device FROM events")
def str_20_ownership(spark, d):
    e = told(spark, d)
    protocol = F.when(F.col("event_type") != "click", "protocol").otherwise("")
    owner = live.route_owner(protocol, F.lit("current"), F.when(F.col("value") > 30, "activity").otherwise(""), F.when(F.col("value") < 60, protocol).otherwise("other"), F.lit(False))
    return e.select("event_id", owner.alias("device"))


@query("WITH d AS (SELECT user_id AS device, arg_max(event_type, (ts, event_id)) AS stream, max((ts, event_id)) AS last FROM events GROUP BY 1) SELECT stream, arg_max(device, last) AS device FROM d GROUP BY 1")
def str_21_output_index(spark, d):
    rows = told(spark, d).select(F.col("user_id").alias("device"), F.col("event_type").alias("stream"), F.struct("ts", "event_id").alias("at"))
    return live.outputs_by_stream(rows, "device", "stream", "at")


@query("SELECT user_id, event_id FROM events e WHERE event_type <> 'view' OR NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase')")
def str_26_fallback_promoted(spark, d):
    # Mixed frames (views) are played only where a session never had frames of its own (purchases).
    return live.promoted(told(spark, d), "user_id", F.col("event_type") == "view", F.col("event_type") == "purchase").select("user_id", "event_id")


@query("WITH f AS (SELECT event_type AS source, user_id AS device, min(event_id) AS first_id FROM events GROUP BY ALL) SELECT source, device, row_number() OVER (ORDER BY first_id) - 1 AS channel FROM (SELECT device, min(first_id) AS first_id, arg_min(source, first_id) AS source FROM f GROUP BY device)")
def str_32_stable_channels(spark, d):
    return live.stable_channels(told(spark, d), "user_id", "event_type", "event_id").select(F.col("event_type").alias("source"), F.col("user_id").alias("device"), "channel")


@query("SELECT vec_id, 128 AS samples FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) >= 0.3")
def str_34_frame_pipeline(spark, d):
    e = F.col("embedding")
    mixed = v.downmixed(F.array(e, e))
    loud = read(spark, d, "embeddings").withColumn("mono", mixed).filter(v.peak(F.col("mono")) >= 0.3)
    return loud.select("vec_id", F.size(v.resampled(F.col("mono"), 8000, 16000)).alias("samples"))


@query("SELECT date_trunc('hour', ts) AS hour, any_value(user_id) AS user_id FROM events WHERE value > 60 GROUP BY 1 HAVING count(DISTINCT user_id) = 1")
def str_35_single_source(spark, d):
    frames = told(spark, d).filter("value > 60").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.collect_set("user_id").alias("sources"))
    return frames.filter(F.size("sources") == 1).select("hour", F.get("sources", F.lit(0)).alias("user_id"))


@query("SELECT user_id, event_type = 'signup' AS gone FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1)")
def str_37_departed(spark, d):
    last = told(spark, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.select("user_id", (F.col("last") == "signup").alias("gone"))


VOICES = """SELECT user_id AS key, event_type = 'signup' AS leaves, epoch_us(ts) // 1000 AS at_ms, round(value * 1000)::BIGINT AS ms FROM events"""
#: Only what the query is about ends a segment.
ENDLESS = sessions.Pauses(short=1 << 50, enough=1 << 50, long=1 << 51, most=1 << 50, least=1, quiet=0.0, preview=1 << 50)


@query(f"""WITH v AS ({VOICES}), i AS (SELECT *, max(at_ms + ms) OVER (PARTITION BY key ORDER BY at_ms, ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM v WHERE ms > 0)
SELECT key, min(at_ms) AS start_ms, max(at_ms + ms) AS end_ms, count(*) + count_if(at_ms > ended) AS frames FROM i GROUP BY key""")
def str_5_gaps(spark, d):
    # Each pause is a frame of silence.
    frames = sessions.frames_of(told(spark, d))
    return sessions.batch_segments(frames, ENDLESS).select("key", "start_ms", "end_ms", "frames")


@query(f"""WITH v AS ({VOICES}), i AS (SELECT *, count_if(leaves) OVER (PARTITION BY key ORDER BY at_ms, NOT leaves RANGE UNBOUNDED PRECEDING) AS island FROM v), s AS (SELECT key, island, min(at_ms) AS start_ms, max(at_ms + ms) AS end_ms FROM i WHERE NOT leaves AND ms > 0 GROUP BY ALL)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY island) - 1 AS segment, start_ms, end_ms FROM s""")
def str_6_left(spark, d):
    leaves = F.col("event_type") == "signup"
    said = told(spark, d)
    frames = sessions.frames_of(said.filter(~leaves)).unionByName(sessions.frames_of(said.filter(leaves)).withColumn("ms", F.lit(0).cast("long")).withColumn("energy", F.lit(None).cast("double")))
    return sessions.batch_segments(frames, ENDLESS).select("key", "segment", "start_ms", "end_ms")


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id, CASE WHEN value > 20 THEN event_type END AS person, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::VARCHAR AS owner, NULL::VARCHAR AS voter, 0 AS votes, 0 AS waits, false AS held, NULL::VARCHAR AS bound FROM events
UNION ALL SELECT user_id, i, coalesce(bound, owner), voter, votes, CASE WHEN bound IS NULL THEN waits ELSE 0 END, held, bound FROM (
SELECT *, CASE WHEN won THEN person WHEN waits >= 16 AND owner IS DISTINCT FROM 'track:' || user_id THEN 'track:' || user_id END AS bound, CASE WHEN won THEN NULL ELSE v END AS voter, CASE WHEN won THEN 0 ELSE c END AS votes FROM (
SELECT *, waited + held::INT AS waits FROM (
SELECT *, CASE WHEN person IS NULL THEN owner IS NULL ELSE person IS DISTINCT FROM owner AND c < 3 END AS held, person IS NOT NULL AND c >= 3 AS won FROM (
SELECT n.user_id, n.i, n.person, f.owner, f.waits AS waited,
CASE WHEN person IS NULL THEN f.voter WHEN person IS DISTINCT FROM f.owner THEN person END AS v,
CASE WHEN person IS NULL THEN f.votes WHEN person IS NOT DISTINCT FROM f.owner THEN 0 WHEN person = f.voter THEN f.votes + 1 ELSE 1 END AS c FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)))))
SELECT f.user_id, event_id, held, CASE WHEN held THEN first_value(bound IGNORE NULLS) OVER (PARTITION BY f.user_id ORDER BY f.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE last_value(bound IGNORE NULLS) OVER (PARTITION BY f.user_id ORDER BY f.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS owner FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i""")
def str_17_rebound(spark, d):
    rows = told(spark, d).withColumn("person", F.when(F.col("value") > 20, F.col("event_type")))
    return live.rebound(rows, "user_id", "event_id", "person", ["ts", "event_id"])
