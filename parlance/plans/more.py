"""Queries of sinks, deliveries, markup and sources over the driver's tables, beside their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import markup
from parlance.operators import delivery
from parlance.plans.library import MEETINGS, meetings
from parlance.plans.queries import query
from parlance.sources import voices
from parlance.sources.stored import scratch_dir
from parlance.sources.tables import installed, read
from parlance.streaming import sinks

# Sinks: the batches of a stream come one after another, and one of them twice.


def sent(write: sinks.Write, batches: list[DataFrame], ledger: str, name: str) -> None:
    """The batches through a sink with a ledger; the second comes again with the ledger, and again as if that were lost."""
    through = sinks.once(ledger, name, write)
    for batch, rows in enumerate(batches):
        through(rows, batch)
    through(batches[1], 1)
    write(batches[1], 1)


def folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def versions(spark, d) -> list[DataFrame]:
    """Three batches of meetings (id, version, document, header, ended): all turns up to 1, up to 3, and all; the last two leave some out."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", "text")
    whole = lambda rows, v: rows.groupBy("id").agg(F.lit(v).cast("long").alias("version"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))).alias("document"), F.concat(F.count("*").cast("string"), F.lit(" turns")).alias("header"), F.lit(v == 2).alias("ended"))
    return [whole(c.filter("turn <= 1"), 0), whole(c.filter("turn <= 3 AND id % 3 <> 0"), 1), whole(c.filter("id % 2 = 0"), 2)]


@query("""WITH v AS (SELECT conv_id AS id, 0 AS version, list({'role': role, 'text': text} ORDER BY turn) AS turns FROM conversations WHERE turn <= 1 GROUP BY 1 UNION ALL
SELECT conv_id, 1, list({'role': role, 'text': text} ORDER BY turn) FROM conversations WHERE turn <= 3 AND conv_id % 3 <> 0 GROUP BY 1 UNION ALL SELECT conv_id, 2, list({'role': role, 'text': text} ORDER BY turn) FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1)
SELECT id, max(version)::BIGINT AS version, len(arg_max(turns, version)) || ' turns' AS header, arg_max(list_transform(turns, lambda x: x.role || ': ' || coalesce(x.text, '')), version) AS turns FROM v GROUP BY id""")
def snk_1_saved(spark, d):
    path = folder(spark, "saved")
    sent(sinks.save_documents(path), versions(spark, d), f"{path}/ledger", "documents")
    turns = F.transform(F.from_json("document", "array<struct<role:string,text:string>>"), lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit(""))))
    return sinks.saved_documents(spark, path).select("id", "version", "header", turns.alias("turns"))


@query("""SELECT sha256(event_id::VARCHAR) AS id, 1 AS schema_version, epoch_us(ts) AS occurred_us, CASE event_type WHEN 'signup' THEN 'kualiJoined' WHEN 'view' THEN 'participantJoined' ELSE event_type END AS event, (event_id % 5)::VARCHAR AS guild_id, event_id::VARCHAR AS channel_id,
user_id::VARCHAR AS participant_user_id, 'user ' || user_id AS participant_display_name, CASE WHEN event_type NOT IN ('signup', 'view') THEN 'notice' END AS notice_text, CASE WHEN value > 20 THEN props END AS detail FROM events""")
def snk_5_audit(spark, d):
    e = read(spark, d, "events")
    event = F.when(F.col("event_type") == "signup", "kualiJoined").when(F.col("event_type") == "view", "participantJoined").otherwise(F.col("event_type"))
    rows = e.select("event_id", F.col("ts").cast("timestamp").alias("occurred_at"), event.alias("event"), (F.col("event_id") % 5).alias("guild_id"), F.col("event_id").alias("channel_id"), "user_id", F.concat(F.lit("user "), "user_id").alias("name"), F.when(F.col("value") > 20, F.col("props")).alias("detail"))
    path = folder(spark, "audit")
    sent(sinks.append_audit(path, "notice"), [rows.filter(F.col("event_id") % 3 == i) for i in range(3)], f"{path}-ledger", "audit")
    return sinks.audit_trail(spark, path).withColumn("occurred_us", F.unix_micros("occurred_at")).drop("occurred_at")


@query("SELECT event_id AS seq, event_type AS event, user_id, round(value, 2) AS value FROM events")
def snk_10_emitted(spark, d):
    rows = read(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    path = folder(spark, "emitted")
    sent(sinks.emit_events(path, "event_type", ["user_id", "value"], "event_id"), [rows.filter(F.col("event_id") % 3 == i) for i in range(3)], f"{path}-ledger", "events")
    payload = F.from_json("payload", "user_id long, value double")
    return sinks.emitted_events(spark, path).select("seq", "event", payload["user_id"].alias("user_id"), F.round(payload["value"], 2).alias("value"))


@query("WITH n AS (SELECT conv_id AS id, count(*) AS turns, max(length(text)) AS longest FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1) SELECT id, 2::BIGINT AS version, CASE WHEN longest > 600 THEN 'failed' ELSE turns || ' turns' END AS outcome FROM n")
def str_29_finished(spark, d):
    """A meeting that ends is saved, then summed up; one that fails stops no other, and one sent again isn't done twice."""
    turns = F.from_json("document", "array<struct<role:string,text:string>>")
    longest = F.array_max(F.transform(turns, lambda x: F.coalesce(F.char_length(x["text"]), F.lit(0))))
    path = folder(spark, "finished")
    work = sinks.finish(path, lambda ready: ready.select("id", "version", F.when(longest > 600, "failed").otherwise(F.col("header")).alias("outcome")))
    sent(work, versions(spark, d), f"{path}-ledger", "finish")
    return sinks.finished(spark, path)


# Sources


@query("""WITH o AS (SELECT user_id, event_type AS ssrc, epoch_us(ts) // 1000 AS at_ms, event_id FROM events WHERE event_id % 4 = 0), f AS (SELECT event_id AS frame, event_type AS ssrc, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_id % 4 <> 0)
SELECT f.frame, arg_max(o.user_id, (o.at_ms, o.event_id)) AS user_id FROM f JOIN o ON o.ssrc = f.ssrc AND o.at_ms <= f.at_ms AND o.at_ms > f.at_ms - 3600000 GROUP BY f.frame HAVING arg_max(o.user_id, (o.at_ms, o.event_id)) <> 3""")
def src_7_owned_sound(spark, d):
    frames, owners = heard(read(spark, d, "events"))
    return voices.owned(frames, owners, 3_600_000, itself=3).select("frame", "user_id")


def heard(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of sound and announcements of whose a stream is, an event in four."""
    e = events.select("event_id", "user_id", F.col("event_type").alias("ssrc"), F.col("ts").cast("timestamp").alias("at"))
    return e.filter("event_id % 4 <> 0").select(F.col("event_id").alias("frame"), "ssrc", "at"), e.filter("event_id % 4 = 0").select("ssrc", "user_id", "at", F.col("event_id").alias("seq"))


@query("SELECT event_id, user_id FROM events WHERE user_id IS DISTINCT FROM 3")
def flt_13_not_itself(spark, d):
    return voices.without_itself(read(spark, d, "events").select("event_id", "user_id"), "user_id", 3)


@query()
def src_20_weights(spark, d):
    return installed(spark, d)


TAG = r"""(?i)<[a-z][^\s>/]*\s(?:[^>]*\s)?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))[^>]*>([^<]*)"""


@query(f"""WITH h AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>', '', 'g') AS html FROM pages),
t AS (SELECT page_id, regexp_extract_all(html, '{TAG}', 1) AS a, regexp_extract_all(html, '{TAG}', 2) AS b, regexp_extract_all(html, '{TAG}', 3) AS c, regexp_extract_all(html, '{TAG}', 4) AS n FROM h),
u AS (SELECT page_id, list_filter(list_transform(range(1, len(a) + 1), lambda i: {{'id': trim(coalesce(a[i], '') || coalesce(b[i], '') || coalesce(c[i], '')), 'name': coalesce(nullif(trim(n[i]), ''), 'Participante')}}), lambda x: x.id <> '') AS tiles FROM t),
f AS (SELECT page_id, generate_subscripts(tiles, 1) - 1 AS place, unnest(tiles) AS tile FROM u)
SELECT page_id, min(place)::INTEGER AS place, tile.id AS id, arg_min(tile.name, place) AS name FROM f GROUP BY page_id, tile.id""")
def src_21_roster(spark, d):
    return markup.first_tiles(read(spark, d, "pages"), "html", "href", "page_id")


# Markup and names

SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Texts as they are, and with marks put where sentences end and begin, so that every kind of block occurs.
MARKED = r"regexp_replace(regexp_replace(regexp_replace(text, '[.] ([^\W\d_]+)', E'.\n- **\\1** _x_', 'g'), ', ([^\W\d_]+) ', E'\n\n3) `\\1` *', 'g'), '- [*][*]([aeiou])', E'\\1 __y__ *z* \n  ', 'g')"


@query(f"""WITH d AS (SELECT doc_id AS id, 'plain' AS form, text FROM documents UNION ALL SELECT doc_id, 'marked', {MARKED} FROM documents),
l AS (SELECT id, form, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT id, form, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', E'\\n', 'g'), E'\\n') AS x FROM d)),
k AS (SELECT *, CASE WHEN regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') = '' THEN '' WHEN regexp_matches(line, '^{SPACE}*[-*+]{SPACE}+') THEN 'ul' WHEN regexp_matches(line, '^{SPACE}*[0-9]+[.)]{SPACE}+') THEN 'ol' ELSE 'p' END AS kind FROM l),
c AS (SELECT *, (lag(kind) OVER (PARTITION BY id, form ORDER BY pos) IS DISTINCT FROM kind)::INTEGER AS changed FROM k), r AS (SELECT *, sum(changed) OVER (PARTITION BY id, form ORDER BY pos) AS run FROM c),
b AS (SELECT *, dense_rank() OVER (PARTITION BY id, form ORDER BY run) - 1 AS block FROM r WHERE kind <> ''),
i AS (SELECT id, form, block, kind, 0 AS item, string_agg(regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g'), ' ' ORDER BY pos) AS text FROM b WHERE kind = 'p' GROUP BY ALL UNION ALL
SELECT id, form, block, kind, row_number() OVER (PARTITION BY id, form, block ORDER BY pos) - 1, regexp_replace(line, '^{SPACE}*(?:[-*+]|[0-9]+[.)]){SPACE}+', '') FROM b WHERE kind <> 'p'),
m AS (SELECT *, regexp_split_to_array(text, '{markup.MARKS}') AS t, regexp_extract_all(text, '{markup.MARKS}') AS f FROM i),
n AS (SELECT id, form, block, kind, item, list_filter(flatten(list_transform(range(1, len(t) + 1), lambda j: [{{'mark': '', 'text': t[j]}}, CASE WHEN j <= len(f) THEN CASE WHEN starts_with(f[j], '`') THEN {{'mark': 'code', 'text': f[j][2:-2]}} WHEN starts_with(f[j], '**') OR starts_with(f[j], '__') THEN {{'mark': 'strong', 'text': f[j][3:-3]}} ELSE {{'mark': 'em', 'text': f[j][2:-2]}} END END])), lambda x: x IS NOT NULL AND x.text <> '') AS nodes FROM m)
SELECT id, form, block::INTEGER AS block, kind, item::INTEGER AS item, list_transform(nodes, lambda x: x.mark || ':' || x.text) AS nodes FROM n""")
def scl_t13_markdown(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"[.] ([^\W\d_]+)", ".\n- **$1** _x_"), r", ([^\W\d_]+) ", "\n\n3) `$1` *"), r"- [*][*]([aeiou])", "$1 __y__ *z* \n  ")
    both = docs.withColumn("form", F.lit("plain")).unionByName(docs.select("id", marked.alias("text"), F.lit("marked").alias("form")))
    found = markup.items(both, F.col("text"), "id", "form")
    return found.select("id", "form", "block", "kind", "item", F.transform("nodes", lambda n: F.concat(n["mark"], F.lit(":"), n["text"])).alias("nodes"))


@query(r"""WITH t AS (SELECT doc_id, [w for w in regexp_extract_all(coalesce(text, ''), '[^\s'']+') ] AS w FROM documents),
q AS (SELECT doc_id, list_transform(w[1:12] || w[-4:], lambda x: lower(x)) AS inside, len(w) AS n FROM t)
SELECT doc_id, (SELECT list(x ORDER BY p) FROM (SELECT x, min(i) AS p FROM (SELECT unnest(inside) AS x, generate_subscripts(inside, 1) AS i) WHERE regexp_full_match(x, '[a-z0-9][-a-z0-9._:\[\]]{1,63}') GROUP BY x)) AS aliases FROM q""")
def scl_t22_aliases(spark, d):
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\s']+"), F.lit(0))
    words = read(spark, d, "documents").select("doc_id", w.alias("w"))
    last = F.when(F.size("w") > 4, F.slice("w", -4, 4)).otherwise(F.col("w"))
    quoted = F.array_join(F.transform(F.concat(F.slice("w", 1, 12), last), lambda x: F.concat(F.lit("'"), F.lower(x), F.lit("'"))), ", ")
    lines = F.concat(F.lit("Usage: x [options] 'not-this'\n  -p, --print  also 'not-this-one'\n      --model <m>  one of\n        "), quoted, F.lit("\n  --models 'nor-this'\n"))
    return words.select("doc_id", F.nullif(markup.model_aliases(lines), F.array().cast("array<string>")).alias("aliases"))


@query("""SELECT event_id, event_id % 40 IN (1, 2, 3, 4, 29) OR event_type = 'error' AS stops FROM events""")
def scl_t20_failures(spark, d):
    said = F.concat_ws(" ", F.concat(F.lit("HTTP "), F.col("event_id") % 40 + 400), F.when(F.col("event_type") == "error", "Rate Limit of user").otherwise("try again"), "user_id")
    return read(spark, d, "events").select("event_id", delivery.needs_attention(said).alias("stops"))


@query("""WITH m AS (SELECT p_partkey % 11 AS provider, p_partkey AS created, CASE WHEN p_partkey % 11 = 4 THEN 'TTS-' || p_partkey WHEN p_partkey % 5 = 0 THEN 'Text-Embedding-' || p_partkey WHEN p_partkey % 7 = 0 THEN 'dall-e ' || p_partkey ELSE 'chat ' || p_brand END AS name FROM part), f AS (SELECT *, NOT regexp_matches(lower(name), 'embed|tts|dall-e') AS fit FROM m)
SELECT provider, name, created FROM (SELECT *, bool_or(fit) OVER (PARTITION BY provider) AS any_fit FROM f) WHERE fit OR NOT any_fit""")
def flt_15_for_chat(spark, d):
    key = F.col("p_partkey")
    name = F.when(key % 11 == 4, F.concat(F.lit("TTS-"), key)).when(key % 5 == 0, F.concat(F.lit("Text-Embedding-"), key)).when(key % 7 == 0, F.concat(F.lit("dall-e "), key)).otherwise(F.concat(F.lit("chat "), "p_brand"))
    models = read(spark, d, "part").select((key % 11).alias("provider"), name.alias("name"), key.alias("created"))
    return delivery.for_chat(models, "provider", "name")


# Deliveries

LISTS = [("all", "all", None, None, True, b"k" * 24), ("one", "channel", 3, "BUILDING", True, bytes(range(64))), ("off", "all", None, None, False, b"z" * 24), ("two", "channel", 7, "MACHINERY", True, b"\xff" * 40)]


def lists(spark) -> DataFrame:
    return spark.createDataFrame(LISTS, "name string, scope string, guild int, channel string, enabled boolean, secret binary")


@query(f"WITH {MEETINGS} SELECT id, 'all' AS target FROM m UNION ALL SELECT id, 'one' FROM m WHERE guild_id = 3 AND channel = 'BUILDING' UNION ALL SELECT id, 'two' FROM m WHERE guild_id = 7 AND channel = 'MACHINERY'")
def snk_9_fan_out(spark, d):
    return delivery.fan_out(meetings(spark, d).select("id", "guild_id", "channel"), lists(spark), "guild_id", "channel").select("id", F.col("name").alias("target"))


def _padded(secret: bytes, with_: int) -> str:
    return "".join(f"\\x{b ^ with_:02X}" for b in secret.ljust(64, b"\0"))


SECRETS = "s AS (FROM (VALUES " + ", ".join(f"('{n}', '{_padded(k, 0x36)}'::BLOB, '{_padded(k, 0x5C)}'::BLOB)" for n, _, _, _, on, k in LISTS if on) + ") t(target, inner_pad, outer_pad))"


@query(f"""WITH {MEETINGS}, {SECRETS}, t AS (SELECT id, 'all' AS target FROM m UNION ALL SELECT id, 'one' FROM m WHERE guild_id = 3 AND channel = 'BUILDING' UNION ALL SELECT id, 'two' FROM m WHERE guild_id = 7 AND channel = 'MACHINERY'),
b AS (SELECT id, target, 'msg_' || md5(target || ':' || id) AS message_id, '{{"type":"meeting.completed","timestamp":"' || (1767310200 + id) || '","data":{{"id":"' || id || '","name":"' || m.name || '"}}}}' AS body, (1767310200 + id)::VARCHAR AS stamp FROM t JOIN m USING (id)),
g AS (SELECT *, encode(message_id || '.' || stamp || '.' || body) AS said FROM b)
SELECT id, target, message_id, body, 'v1,' || base64(unhex(sha256(outer_pad || unhex(sha256(inner_pad || said))))) AS signature FROM g JOIN s USING (target)""")
def snk_6_signed(spark, d):
    m = meetings(spark, d).select("id", "guild_id", "channel", F.col("name").alias("title"))
    rows = delivery.fan_out(m, lists(spark), "guild_id", "channel").join(lists(spark).select("name", "secret"), "name")
    stamp = (F.lit(1767310200) + F.col("id")).cast("string")
    body = delivery.envelope("meeting.completed", stamp, F.struct(F.col("id").cast("string").alias("id"), F.col("title").alias("name")))
    made = delivery.signed(rows, F.concat(F.lit("msg_"), F.md5(F.concat_ws(":", "name", "id"))), stamp, body, F.col("secret"))
    return made.select("id", F.col("name").alias("target"), "message_id", "body", "signature")


@query("""WITH d AS (SELECT (range)::BIGINT AS nth, [0, 5, 300, 1800, 7200, 18000, 36000, 50400, 72000, 86400][range + 1] AS base FROM range(10))
SELECT o_orderkey, nth::INTEGER + 1 AS attempt, (CASE WHEN base = 0 THEN 0 WHEN o_orderkey % 6 = 0 THEN o_orderkey % 100 ELSE base + ('0x' || substr(md5(o_orderkey || ':' || nth), 1, 8))::BIGINT % (greatest(base // 5, 1) + 1) END)::BIGINT AS after_s FROM orders, d""")
def snk_6_tries(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey")
    return delivery.tries(rows, F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 6 == 0, F.col("o_orderkey") % 100))
