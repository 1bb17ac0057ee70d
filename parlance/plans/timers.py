"""Queries of folds with timers over the driver's events, beside recursive SQL. A session is a user, its time made faster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.plans.queries import query
from parlance.sources.tables import read
from parlance.streaming import timers
from parlance.streaming.keyed import batch_fold


def rows(spark, d, faster: int, **columns: Column) -> DataFrame:
    """(key, at_ms, row_id, others) of the events, ``faster`` times as fast."""
    at = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / faster).cast("long")
    return read(spark, d, "events").select(F.col("user_id").alias("key"), at.alias("at_ms"), F.col("event_id").alias("row_id"), *[c.alias(n) for n, c in columns.items()])


EVENTS = "e AS (SELECT user_id AS key, event_id AS row_id, epoch_us(ts) // ({0} * 1000) AS at_ms, event_type, value FROM events)"
SESSIONS = f"""{EVENTS.format(1000)}, i AS (SELECT *, (at_ms - lag(at_ms) OVER (PARTITION BY key ORDER BY at_ms, row_id) >= 50000)::INTEGER AS fresh FROM e),
s AS (SELECT *, sum(coalesce(fresh, 0)) OVER (PARTITION BY key ORDER BY at_ms, row_id)::INTEGER AS session FROM i)"""
N = "n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, row_id) AS i FROM e)"


@query(f"WITH {SESSIONS} SELECT key, session, min(at_ms) AS started_ms, max(at_ms) + 50000 AS ended_ms, count(*) AS messages FROM s GROUP BY key, session")
def str_11_liveness(spark, d):
    return batch_fold(rows(spark, d, 1000), timers.Liveness, ["row_id"], timers.LIVENESS)


@query(f"""WITH {SESSIONS}, b AS (SELECT key, session, min(at_ms) AS started, max(at_ms) + 50000 AS ended FROM s GROUP BY key, session), t AS (SELECT key, session, unnest(range(started + 5000, ended, 5000)) AS at_ms FROM b)
SELECT t.key, t.session, t.at_ms, count(*) AS frames, sum(round(value)::BIGINT)::BIGINT AS samples, max(value) AS peak FROM t JOIN s ON s.key = t.key AND s.session = t.session AND s.at_ms < t.at_ms GROUP BY ALL""")
def str_24_health(spark, d):
    frames = rows(spark, d, 1000, samples=F.round("value").cast("long"), peak=F.col("value"))
    return batch_fold(frames, timers.Health, ["row_id"], timers.HEALTH)


@query(f"""WITH RECURSIVE {EVENTS.format(100000)}, {N}, f AS (SELECT key, i, row_id, at_ms AS scan_ms, true AS scanned FROM n WHERE i = 1
UNION ALL SELECT n.key, n.i, n.row_id, CASE WHEN n.at_ms - f.scan_ms >= 250 THEN n.at_ms ELSE f.scan_ms END, n.at_ms - f.scan_ms >= 250 FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1)
SELECT key, row_id, scan_ms, scanned FROM f""")
def str_24_throttled(spark, d):
    return batch_fold(rows(spark, d, 100000), timers.Throttle, ["row_id"], timers.THROTTLE)


@query(f"""WITH {EVENTS.format(10000)}, p AS (SELECT *, event_type IN ('click', 'view') AS present FROM e), w AS (SELECT *, lag(present) OVER (PARTITION BY key ORDER BY at_ms, row_id) AS was,
min(CASE WHEN present THEN at_ms END) OVER (PARTITION BY key ORDER BY at_ms, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM p)
SELECT key, at_ms AS absent_ms, at_ms + 3500 AS stop_ms FROM w WHERE NOT present AND was AND (back IS NULL OR back >= at_ms + 3500)""")
def str_25_grace(spark, d):
    return batch_fold(rows(spark, d, 10000, present=F.col("event_type").isin("click", "view")), timers.Grace, ["row_id"], timers.GRACE)


@query(f"""WITH RECURSIVE {EVENTS.format(1000)}, {N}, m AS (SELECT key, i, row_id, at_ms, row_id % 9 AS segment, event_type = 'purchase' AND value > 60 AS is_final, at_ms + (value * 4000)::BIGINT AS ends FROM n),
f AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS row_id, NULL::VARCHAR AS outcome, []::STRUCT(s BIGINT, e BIGINT)[] AS flight, []::BIGINT[] AS closed FROM (SELECT DISTINCT key FROM m)
UNION ALL SELECT key, i, row_id, outcome, CASE WHEN outcome = 'preview' THEN list_append(now, {{'s': segment, 'e': ends}}) ELSE now END, CASE WHEN is_final THEN list_append(closed, segment) ELSE closed END FROM (
SELECT *, CASE WHEN is_final THEN 'final' WHEN list_contains(closed, segment) THEN 'closed' WHEN len(list_filter(now, lambda x: x.s = segment)) > 0 THEN 'same' WHEN len(now) >= 4 THEN 'full' ELSE 'preview' END AS outcome FROM (
SELECT m.*, f.closed, list_filter(f.flight, lambda x: x.e > m.at_ms) AS now FROM f JOIN m ON m.key = f.key AND m.i = f.i + 1)))
SELECT key, row_id, outcome, len(flight)::INTEGER AS in_flight FROM f WHERE i > 0""")
def str_8_previews(spark, d):
    asked = rows(spark, d, 1000, segment=F.col("event_id") % 9, is_final=(F.col("event_type") == "purchase") & (F.col("value") > 60), work_ms=F.round(F.col("value") * 4000).cast("long"))
    return batch_fold(asked, timers.Previews, ["row_id"], timers.PREVIEWS)


@query(f"""WITH RECURSIVE {EVENTS.format(5000)}, k AS (SELECT *, row_id % 3 AS person, CASE event_type WHEN 'purchase' THEN CASE WHEN value > 60 THEN 'audio' ELSE 'speaking' END WHEN 'signup' THEN CASE WHEN value > 90 THEN 'left' ELSE 'speaking' END ELSE 'speaking' END AS kind FROM e),
w AS (SELECT *, lead(at_ms) OVER (PARTITION BY key, person ORDER BY at_ms, row_id) AS next_ms FROM k),
x AS (SELECT key, at_ms + 6000 AS at_ms, 0 AS late, person, NULL::BIGINT AS row_id FROM w WHERE kind = 'speaking' AND (next_ms IS NULL OR next_ms >= at_ms + 6000) UNION ALL SELECT key, at_ms, 1, person, row_id FROM w WHERE kind <> 'speaking'),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, late, CASE late WHEN 0 THEN person ELSE row_id END) AS i FROM x),
f AS (SELECT key, 0::BIGINT AS i, 0::BIGINT AS at_ms, 1 AS late, 0::BIGINT AS person, NULL::VARCHAR AS outcome, 0::INTEGER AS attempt, NULL::BIGINT AS cool, NULL::BIGINT AS busy, MAP {{}}::MAP(BIGINT, INTEGER) AS attempts FROM (SELECT DISTINCT key FROM n)
UNION ALL SELECT key, i, at_ms, late, person, outcome, attempt, CASE WHEN outcome = 'queued' THEN at_ms + 30000 ELSE cool END, CASE WHEN outcome = 'queued' THEN at_ms + 5000 ELSE busy END,
CASE WHEN late = 1 THEN map_concat(attempts, MAP {{person: 0::INTEGER}}) WHEN outcome IN ('queued', 'exhausted') THEN map_concat(attempts, MAP {{person: attempt}}) ELSE attempts END FROM (
SELECT *, CASE WHEN late = 1 THEN NULL WHEN at_ms < cool OR at_ms < busy THEN 'recovering' WHEN had + 1 > 3 THEN 'exhausted' ELSE 'queued' END AS outcome, CASE WHEN at_ms < cool OR at_ms < busy THEN had ELSE had + 1 END::INTEGER AS attempt FROM (
SELECT n.key, n.i, n.at_ms, n.late, n.person, f.cool, f.busy, f.attempts, coalesce(f.attempts[n.person], 0) AS had FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1)))
SELECT key, at_ms, person, outcome, attempt FROM f WHERE late = 0""")
def str_28_watchdog(spark, d):
    value, event = F.col("value"), F.col("event_type")
    kind = F.when((event == "purchase") & (value > 60), "audio").when((event == "signup") & (value > 90), "left").otherwise("speaking")
    return batch_fold(rows(spark, d, 5000, person=F.col("event_id") % 3, kind=kind), timers.Watchdog, ["row_id"], timers.WATCHDOG)


@query(f"""WITH {EVENTS.format(1000)}, k AS (SELECT *, row_id % 3 AS person, CASE event_type WHEN 'click' THEN 'on' WHEN 'purchase' THEN 'off' WHEN 'signup' THEN CASE WHEN value > 60 THEN 'end' ELSE 'tick' END ELSE 'tick' END AS kind FROM e),
o AS (SELECT *, coalesce(count_if(kind = 'end') OVER (PARTITION BY key ORDER BY at_ms, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM k),
c AS (SELECT *, count_if(kind = 'tick') OVER (PARTITION BY key, epoch ORDER BY at_ms, row_id ROWS UNBOUNDED PRECEDING) AS clock FROM o),
g AS (SELECT *, coalesce(count_if(kind = 'off') OVER (PARTITION BY key, epoch, person ORDER BY at_ms, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM c WHERE kind IN ('on', 'off')),
b AS (SELECT key, epoch, person, span, arg_min(at_ms, (at_ms, row_id)) FILTER (kind = 'on') AS started_ms, arg_min(clock, (at_ms, row_id)) FILTER (kind = 'on') AS begun, max(at_ms) FILTER (kind = 'off') AS off_ms, max(clock) FILTER (kind = 'off') AS off_clock FROM g GROUP BY ALL)
SELECT b.key, b.person, b.started_ms, coalesce(off_ms, e.at_ms) AS ended_ms, coalesce(off_clock, e.clock) - begun AS ticks FROM b LEFT JOIN c e ON e.key = b.key AND e.epoch = b.epoch AND e.kind = 'end' WHERE started_ms IS NOT NULL AND coalesce(off_ms, e.at_ms) IS NOT NULL""")
def str_15_sessions(spark, d):
    return batch_fold(spoken(spark, d), timers.Session, ["row_id"], timers.SPEECH)


def spoken(spark, d) -> DataFrame:
    event = F.col("event_type")
    kind = F.when(event == "click", "on").when(event == "purchase", "off").when((event == "signup") & (F.col("value") > 60), "end").otherwise("tick")
    return rows(spark, d, 1000, person=F.col("event_id") % 3, kind=kind)
