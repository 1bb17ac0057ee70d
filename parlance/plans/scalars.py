"""Queries of single functions over the driver's tables: texts, dates, numbers, hashes, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import text as t
from parlance.functions import values as v
from parlance.operators import folds
from parlance.plans.queries import FOLD, TODAY, TOKENS, UTTERANCES, query
from parlance.sources import rosters, wire
from parlance.sources.tables import read, utterances

SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
NAMES = "(SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN ' Ção ' || n_name WHEN 1 THEN n_name || '  ÑÍ-x' WHEN 2 THEN '@' || n_name ELSE n_name END AS name FROM nation)"


def names(spark, d):
    k = F.col("n_nationkey") % 4
    name = F.when(k == 0, F.concat(F.lit(" Ção "), "n_name")).when(k == 1, F.concat("n_name", F.lit("  ÑÍ-x"))).when(k == 2, F.concat(F.lit("@"), "n_name")).otherwise(F.col("n_name"))
    return read(spark, d, "nation").select("n_nationkey", name.alias("name"))


@query(f"SELECT n_nationkey, {FOLD.format('name')} AS plain FROM {NAMES}")
def eq_1_search(spark, d):
    return names(spark, d).select("n_nationkey", t.folded(F.col("name")).alias("plain"))


@query(f"SELECT DISTINCT {FOLD.format('source')} AS key FROM documents WHERE source IS NOT NULL")
def eq_2_link_key(spark, d):
    return read(spark, d, "documents").filter("source IS NOT NULL").select(t.folded(F.col("source")).alias("key")).distinct()


@query(f"SELECT a.n_nationkey, {FOLD.format('a.name')} = {FOLD.format('b.n_name')} AS same FROM {NAMES} a JOIN nation b USING (n_nationkey)")
def eq_3_assignee(spark, d):
    return names(spark, d).join(read(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("n_nationkey", (t.folded(F.col("name")) == t.folded(F.col("n_name"))).alias("same"))


@query(f"SELECT n_nationkey, lower(trim(strip_accents(name))) AS person FROM {NAMES}")
def eq_4_person_key(spark, d):
    return names(spark, d).select("n_nationkey", t.person_key(F.col("name")).alias("person"))


@query(f"SELECT n_nationkey, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS speaker FROM {NAMES}")
def eq_5_ascii(spark, d):
    return names(spark, d).select("n_nationkey", t.ascii_key(F.col("name")).alias("speaker"))


@query(f"SELECT n_nationkey, {TOKENS.replace('text', 'name')} AS tokens FROM {NAMES}")
def eq_6_tokens(spark, d):
    return names(spark, d).select("n_nationkey", t.tokens(F.col("name")).alias("tokens"))


TITLE = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(rf"WITH w AS (SELECT doc_id, {TITLE} AS w FROM documents), c AS (SELECT doc_id, w, left(w, 59) AS c, regexp_extract(left(w, 59), '(?s)^(.*)\s\S*$', 1) AS a FROM w) SELECT doc_id, CASE WHEN length(w) <= 60 THEN w ELSE regexp_replace(CASE WHEN length(a) >= 30 THEN a ELSE c END, '[ :-]+$', '') || '…' END AS title FROM c")
def scl_t7_title(spark, d):
    return read(spark, d, "documents").select("doc_id", t.clamped_title(F.col("text")).alias("title"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN left(p_name, 12) || '…' ELSE p_name END AS after_it, CASE WHEN length(p_name) > 12 THEN left(p_name, 11) || '…' ELSE p_name END AS within FROM part")
def scl_t8_truncated(spark, d):
    return read(spark, d, "part").select("p_partkey", t.truncated(F.col("p_name"), 12).alias("after_it"), t.truncated(F.col("p_name"), 12, whole=False).alias("within"))


@query(f"SELECT doc_id, length({SQUEEZED.format('text')}) AS chars, md5({SQUEEZED.format('text')}) AS digest FROM documents")
def scl_t9_collapsed(spark, d):
    c = t.collapsed(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.length(c).cast("long").alias("chars"), F.md5(c.cast("binary")).alias("digest"))


@query(f"SELECT doc_id, nullif(trim(left({SQUEEZED.format('text')}, 40)), '') AS folder FROM documents")
def scl_t10_folder(spark, d):
    return read(spark, d, "documents").select("doc_id", t.folder_name(F.col("text")).alias("folder"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '([\\*_~`|])', '\\\1', 'g')) AS digest FROM documents")
def scl_t12_markdown(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(t.markdown_escaped(F.col("text")).cast("binary")).alias("digest"))


@query(r"SELECT n_nationkey, regexp_replace(lower(name), '[^\p{L}\p{N}]', '', 'g') AS word FROM " + NAMES)
def scl_t14_bare_word(spark, d):
    return names(spark, d).select("n_nationkey", t.bare_word(F.col("name")).alias("word"))


@query("SELECT p_size, 'En esta reunión hablamos de ' || string_agg(p_brand, ', ' ORDER BY f) || '.' AS prompt FROM (SELECT p_size, p_brand, min(p_partkey) AS f FROM part GROUP BY ALL) GROUP BY 1")
def scl_t15_vocabulary(spark, d):
    lists = read(spark, d, "part").groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_brand"))).alias("p"))
    return lists.select("p_size", t.vocabulary_prompt(F.transform("p", lambda x: F.concat(F.lit(" "), x["p_brand"])), "es").alias("prompt"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_name ELSE 'canal ' || c_custkey % 100 END AS source FROM customer")
def scl_t17_readable(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("Canal "), F.lit(1000000) + k)).when(k % 3 == 1, F.col("c_name")).otherwise(F.concat(F.lit("canal "), k % 100))
    return read(spark, d, "customer").select("c_custkey", t.readable_source(raw).alias("source"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Ana  Luz' ELSE NULL END AS name FROM customer WHERE c_custkey % 5 < 4".replace("'Ana  Luz'", "'Ana Luz'"))
def scl_t18_usable(spark, d):
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, "Participante").when(k == 1, "  Ana   Luz ").when(k == 2, F.concat(F.lit("devices/"), "c_custkey")).otherwise(F.col("c_name"))
    return read(spark, d, "customer").filter("c_custkey % 5 < 4").select("c_custkey", t.usable_name(raw, F.col("c_name")).alias("name"))


@query("SELECT DISTINCT lang, CASE WHEN lang LIKE 'es%' THEN 'es' ELSE 'en' END AS locale FROM documents WHERE lang IS NOT NULL")
def scl_t19_locale(spark, d):
    return read(spark, d, "documents").filter("lang IS NOT NULL").select("lang", t.locale_of(F.col("lang")).alias("locale")).distinct()


@query("SELECT o_orderkey, CASE WHEN b >= 1000000000 THEN printf('%.1f', b / 1e9) || ' GB' ELSE floor(b / 1e6 + 0.5)::BIGINT || ' MB' END AS size, CASE WHEN m < 1 THEN '' WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN m // 60 || ' h' ELSE m // 60 || ' h ' || m % 60 || ' min' END AS length FROM (SELECT o_orderkey, o_orderkey * 7000003 AS b, o_orderkey % 200 AS m FROM orders)")
def scl_t21_labels(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", t.size_label(k * 7000003).alias("size"), t.length_label(k % 200).alias("length"))


@query(f"SELECT n_nationkey, lower(ltrim(trim(name), '@')) AS key FROM {NAMES}")
def scl_t23_match_key(spark, d):
    return names(spark, d).select("n_nationkey", t.match_key(F.col("name")).alias("key"))


@query("SELECT n_nationkey, 'Hola ' || n_name || ', {nadie} { {name}' AS text FROM nation")
def scl_t24_interpolated(spark, d):
    values = F.create_map(F.lit("name"), F.col("n_name"), F.lit("x"), F.lit("{name}"))
    return read(spark, d, "nation").select("n_nationkey", t.interpolated(F.lit("Hola {name}, {nadie} { {x}"), values).alias("text"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'google_meet' WHEN 1 THEN 'zoom' ELSE 'microsoft_teams' END AS platform, CASE c_custkey % 3 WHEN 0 THEN 'abc-' || c_custkey ELSE c_custkey::VARCHAR END AS id FROM customer")
def scl_t25_meeting_url(spark, d):
    k = F.col("c_custkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://meet.google.com/abc-"), k, F.lit("?authuser=0"))).when(k % 3 == 1, F.concat(F.lit("https://us02.zoom.us/wc/"), k, F.lit("/join"))).otherwise(F.concat(F.lit("https://teams.microsoft.com/v2/?meetingId="), k))
    return read(spark, d, "customer").select("c_custkey", t.meeting_of(url, F.lit("title")).alias("m")).select("c_custkey", "m.platform", "m.id")


# Dates


@query("SELECT o_orderkey, CASE WHEN n > 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE CASE n WHEN 0 THEN 'Hoy' ELSE 'Ayer' END || ', ' || strftime(o_orderdate, '%H:%M') END AS day FROM (SELECT *, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS n FROM orders)")
def scl_d4_relative_day(spark, d):
    return read(spark, d, "orders").select("o_orderkey", v.relative_day(F.col("o_orderdate").cast("timestamp_ntz"), TODAY).alias("day"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-07-27' AND DATE '1998-08-02'")
def scl_d5_range(spark, d):
    return read(spark, d, "orders").filter(v.in_days(F.col("o_orderdate").cast("timestamp"), TODAY, 7)).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN least(o_orderdate::DATE, DATE '1996-01-01') ELSE o_orderdate::DATE END AS first, CASE WHEN o_orderkey % 2 = 0 THEN greatest(o_orderdate::DATE, DATE '1996-01-01') END AS last FROM orders")
def scl_d6_picked_range(spark, d):
    opened = F.when(F.col("o_orderkey") % 2 == 0, F.to_date(F.lit("1996-01-01")))
    picked = v.picked_range(opened, F.lit(None).cast("date"), F.to_date("o_orderdate"))
    return read(spark, d, "orders").select("o_orderkey", picked.alias("r")).select("o_orderkey", "r.first", "r.last")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2000-01-01' ELSE o_orderdate::TIMESTAMP END AS at FROM orders")
def scl_d7_parsed_time(spark, d):
    stamp = F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return read(spark, d, "orders").select("o_orderkey", v.parsed_time(stamp, F.lit("2000-01-01 00:00:00").cast("timestamp")).cast("timestamp_ntz").alias("at"))


@query("""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders), c AS (SELECT month, (month - ((isodow(month) - 1)::INTEGER) + i::INTEGER)::DATE AS day FROM m, range(42) r(i))
SELECT month, day, month(day) <> month(month) AS outside, day IN (DATE '1998-07-10') AS edge, day > DATE '1998-07-10' AND day <= DATE '1998-08-02' AS inside, day > DATE '1998-08-02' AS disabled FROM c""")
def scl_d8_calendar(spark, d):
    months = read(spark, d, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).distinct()
    cells = v.calendar_cells(F.col("month"), F.to_date(F.lit("1998-07-10")), F.lit(None).cast("date"), TODAY)
    return months.select("month", F.inline(cells)).select("month", "day", "outside", "edge", "inside", "disabled")


# Numbers and hashes


@query("SELECT o_orderkey, o_orderkey * 16 AS samples, (o_orderkey * 16 + 7) // 16 AS ms, greatest(o_orderkey - 500, 0) AS since FROM orders")
def scl_m1_samples(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", v.to_samples(k).alias("samples"), v.to_ms(k * 16 + 7).alias("ms"), v.saturating_minus(k, F.lit(500)).alias("since"))


@query("SELECT vec_id, list_transform(embedding, lambda x: trunc(greatest(least(x::DOUBLE * 2, 1.0), -1.0) * 32767)::INTEGER) AS pcm FROM embeddings")
def scl_m2_pcm(spark, d):
    return read(spark, d, "embeddings").select("vec_id", v.to_pcm(F.transform("embedding", lambda x: x.cast("double") * 2)).alias("pcm"))


@query("SELECT vec_id, round(CASE WHEN i % 2 = 0 THEN e[i // 2 + 1]::DOUBLE ELSE (e[i // 2 + 1]::DOUBLE + e[least(i // 2 + 2, 64)]::DOUBLE) / 2 END, 6) + 0.0 AS x, i::INTEGER AS i FROM (SELECT vec_id, embedding AS e, unnest(range(128)) AS i FROM embeddings)")
def scl_m3_resampled(spark, d):
    e = read(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(v.resampled(F.col("embedding"), 8000, 16000)).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query("SELECT vec_id, 40 + 8 * (list_position(w, list_min(w)) - 1) + 8 AS cut FROM (SELECT vec_id, list_transform([40, 48], lambda s: round(list_sum(list_transform(list_slice(embedding, s + 1, s + 8), lambda x: x::DOUBLE * x::DOUBLE)), 12)) AS w FROM embeddings)")
def scl_m4_quietest_cut(spark, d):
    return read(spark, d, "embeddings").select("vec_id", v.quietest_split(F.col("embedding"), window=8, search=24).cast("long").alias("cut"))


@query("SELECT o_orderkey, greatest(1000 - o_orderkey, 0) AS left_ms FROM orders")
def scl_m6_saturating(spark, d):
    return read(spark, d, "orders").select("o_orderkey", v.saturating_minus(F.lit(1000), F.col("o_orderkey")).alias("left_ms"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 10 > 0 THEN 5000.0 / (o_orderkey % 10) * 3 END::DOUBLE, 6) AS eta FROM orders")
def scl_m7_remaining(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(v.remaining(F.lit(5000.0), F.col("o_orderkey") % 10, F.lit(3)), 6).alias("eta"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / 2)), 6) AS total FROM embeddings")
def scl_m8_downmix(spark, d):
    e = F.col("embedding")
    mixed = v.downmixed(F.array(e, F.transform(e, lambda x: (x * 0).cast("float"))))
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT c_custkey, (((c_custkey::HUGEINT * 10000000007 % 18446744073709551616) * 11400714819323198485 % 18446744073709551616) // 4294967296 % 8)::BIGINT AS color FROM customer WHERE c_custkey < 0 UNION ALL SELECT c_custkey, ((c_custkey::HUGEINT * 11400714819323198485) % 18446744073709551616 // 4294967296 % 8)::BIGINT FROM customer")
def scl_h2_palette(spark, d):
    return read(spark, d, "customer").select("c_custkey", v.palette_index(F.col("c_custkey")).alias("color"))


@query("SELECT s_suppkey, sha256(s_name) AS digest, 24 + s_suppkey % 60 BETWEEN 24 AND 64 AS usable FROM supplier")
def scl_h4_digest(spark, d):
    secret = F.repeat(F.lit("k"), (F.lit(24) + F.col("s_suppkey") % 60).cast("int"))
    return read(spark, d, "supplier").select("s_suppkey", F.sha2(F.col("s_name").cast("binary"), 256).alias("digest"), F.octet_length(secret).between(24, 64).alias("usable"))


# Arrays and JSON


@query("SELECT conv_id, CASE WHEN n % 2 = 0 THEN ['Ana', 'LUIS'] ELSE ['Ana', 'Luis', 'Eva'] END AS names FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)")
def scl_a2_upserted(spark, d):
    one = lambda i, n: F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"))
    speakers = F.array(one(1, "Ana"), one(2, "Luis"))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    new = F.when(F.col("n") % 2 == 0, one(2, "LUIS")).otherwise(one(3, "Eva"))
    return c.select("conv_id", v.upserted(speakers, new, "id")["name"].alias("names"))


@query("SELECT user_id, coalesce(arg_max(CASE WHEN event_type <> 'error' THEN event_type END, event_id) FILTER (event_type <> 'error'), 'Participante sin identificar') AS name, bool_or(event_type = 'purchase') AS is_self FROM events GROUP BY 1")
def scl_a3_merged_identity(spark, d):
    # An error event says nothing of a name: the last usable one stays.
    name = t.usable_name(F.when(F.col("event_type") == "error", "participant").otherwise(F.col("event_type")))
    last = F.max_by(name, F.when(name.isNotNull(), F.col("event_id")))
    return read(spark, d, "events").groupBy("user_id").agg(F.coalesce(last, F.lit("Participante sin identificar")).alias("name"), F.bool_or(F.col("event_type") == "purchase").alias("is_self"))


@query("SELECT conv_id, list(name ORDER BY f) AS names FROM (SELECT conv_id, role AS name, min(turn) AS f FROM conversations GROUP BY ALL) GROUP BY 1")
def scl_a4_roster(spark, d):
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    entries = F.transform("r", lambda x: F.struct(F.when(x["role"] == "user", " 7 ").otherwise("").alias("id"), F.when(x["turn"] % 2 == 0, F.upper(x["role"])).otherwise(x["role"]).alias("name")))
    return rows.select("conv_id", F.transform(v.unique_roster(entries), lambda x: F.lower(x["name"])).alias("names"))


@query("SELECT event_id, props AS found FROM events")
def scl_j1_json_object(spark, d):
    wrapped = F.concat(F.lit("Sure: "), "props", F.lit(' and {"late": 1} }'))
    return read(spark, d, "events").select("event_id", t.first_json_object(wrapped).alias("found"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN c_name END AS name FROM customer")
def scl_j3_blank(spark, d):
    k = F.col("c_custkey") % 4
    return read(spark, d, "customer").select("c_custkey", v.blank_to_null(F.when(k == 0, " ").when(k == 1, "null").when(k == 2, " NULL ").otherwise(F.col("c_name"))).alias("name"))


@query("SELECT o_orderkey, 'Tarea ' || o_orderkey AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'Ana' END AS assignee, (o_orderkey % 60) * 1000 AS source_ms FROM orders WHERE o_orderkey % 5 > 0")
def scl_j4_summary(spark, d):
    k = F.col("o_orderkey")
    task = F.when(k % 5 == 0, F.struct(F.lit(" ").alias("task"), F.lit("x").alias("owner"), F.lit("").alias("time"))).otherwise(F.struct(F.concat(F.lit(" Tarea "), k).alias("task"), F.when(k % 2 == 0, "Ana").otherwise("null").alias("owner"), F.format_string("00:%02d", k % 60).alias("time")))
    raw = F.concat(F.lit("Here it is:\n"), F.to_json(F.struct(F.lit("Una reunión").alias("meeting_title"), F.array(task).alias("tasks"))), F.lit("\nBye"))
    # Outer: Spark would put filters on the summary below an inner generator, and make it anew for each.
    items = read(spark, d, "orders").select("o_orderkey", F.inline_outer(t.summary_of(raw)["action_items"]))
    return items.filter("text IS NOT NULL").select("o_orderkey", "text", "assignee", "source_ms")


@query("SELECT p_partkey, CASE p_partkey % 1001 WHEN 999 THEN 'Sala' WHEN 1000 THEN 'Tú' END AS name, CASE WHEN p_partkey * 20 < 2048 THEN 3 * 2048 + p_partkey * 20 END AS channel FROM part")
def scl_j5_channels(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", v.reserved_channel(k % 1001).alias("name"), v.frame_channel(F.lit(3), k * 20).alias("channel"))


# Packets


@query("SELECT vec_id, (vec_id % 1000)::INTEGER AS track, vec_id * 1.5::DOUBLE AS ts_ms, CASE WHEN vec_id % 2 = 0 THEN 'Ana ' || vec_id END AS name, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def src_9_frames(spark, d):
    name = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("Ana "), "vec_id"))
    packets = read(spark, d, "embeddings").select("vec_id", wire.encode_frame((F.col("vec_id") % 1000).cast("int"), F.col("vec_id") * 1.5, name, F.col("embedding")).alias("payload"))
    frames = packets.select("vec_id", wire.decode_frame("payload").alias("f"))
    return frames.select("vec_id", "f.track", "f.ts_ms", "f.name", F.round(F.aggregate("f.samples", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("SELECT vec_id, 64 + vec_id % 3 // 3 AS samples FROM embeddings")
def src_11_pcm(spark, d):
    # One to three bytes too many are no sample.
    raw = wire.encode_frame(F.lit(1), F.lit(0.0), F.lit(None).cast("string"), F.col("embedding"))
    torn = F.concat(raw, F.unhex(F.repeat(F.lit("00"), (F.col("vec_id") % 3 + 1).cast("int"))))
    return read(spark, d, "embeddings").select("vec_id", torn.alias("p")).select("vec_id", F.size(wire.decode_frame("p")["samples"]).cast("long").alias("samples"))


@query("SELECT event_id, event_type AS kind, event_id * 0.5::DOUBLE AS ts FROM events WHERE event_id % 4 <> 0")
def src_10_text_frames(spark, d):
    kind = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    text = F.to_json(F.struct(kind.alias("kind"), (F.col("event_id") * 0.5).alias("ts")))
    rows = read(spark, d, "events").select("event_id", wire.event_of(text).alias("e")).filter("e IS NOT NULL")
    return rows.select("event_id", "e.kind", "e.ts")


@query("SELECT event_id, event_type AS kind, event_id * 0.5::DOUBLE AS ts FROM events")
def snk_12_encoded(spark, d):
    text = F.to_json(F.struct(F.col("event_type").alias("kind"), (F.col("event_id") * 0.5).alias("ts")))
    return read(spark, d, "events").select("event_id", wire.event_of(text).alias("e")).select("event_id", "e.kind", "e.ts")


@query("SELECT event_id, props AS text FROM events")
def src_14_inflated(spark, d):
    return read(spark, d, "events").select("event_id", wire.inflated(wire.deflated(F.col("props").cast("binary"))).cast("string").alias("text"))


@query("SELECT conv_id, string_agg(upper(role), '' ORDER BY turn) AS text, false AS refused FROM conversations GROUP BY 1")
def src_16_event_lines(spark, d):
    line = F.concat(F.lit("event: x\ndata: "), F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), F.upper("role").alias("text")).alias("delta"))), F.lit("\n\n"))
    body = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))["line"], "").alias("body"))
    return body.select("conv_id", wire.delta_text(F.col("body")).alias("r")).select("conv_id", "r.text", "r.refused")


@query("SELECT c_custkey, unnest([1, 4, 60])::BIGINT AS number, unnest([2, 0, 5])::INTEGER AS wire, unnest([NULL, c_custkey, NULL])::BIGINT AS value, unnest([hex(c_name), NULL, '00000000']) AS data FROM customer")
def src_12_protobuf(spark, d):
    unknown = F.unhex(F.lit("E50300000000"))
    message = F.concat(rosters.field_bytes(1, F.col("c_name")), rosters.field_bytes(4, F.col("c_custkey"), True), unknown)
    found = read(spark, d, "customer").select("c_custkey", F.explode(rosters.protobuf_fields(message)).alias("f"))
    return found.select("c_custkey", "f.number", "f.wire", "f.value", F.hex("f.data").alias("data"))


def _user(device, name, text, status):
    """A user's message."""
    return F.concat(rosters.field_bytes(1, device), rosters.field_bytes(2, name), rosters.field_bytes(29, text), rosters.field_bytes(4, status, True), rosters.field_bytes(34, (status == 0).cast("long"), True))


@query("""SELECT conv_id, 'd' || turn AS device_id, role AS full_name, coalesce(text, '') AS display_name, turn::BIGINT AS status, turn = 0 AS is_host, NULL AS stream_id, NULL::BOOLEAN AS disabled FROM conversations
UNION ALL SELECT conv_id, 'd' || turn, NULL, NULL, NULL, NULL, 's' || turn, turn % 2 = 1 FROM conversations""")
def src_13_rosters(spark, d):
    device = F.concat(F.lit("d"), "turn")
    status = rosters.field_bytes(1, F.col("turn") % 2, True)
    output = F.concat(rosters.field_bytes(4, F.concat(F.lit("s"), "turn")), rosters.field_bytes(6, device), rosters.field_bytes(10, status))
    user = rosters.field_bytes(2, _user(device, F.col("role"), F.col("text"), F.col("turn")))
    said = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(user).alias("users"), F.collect_list(rosters.field_bytes(2, output)).alias("outputs"))
    body = F.concat(rosters.field_bytes(3, rosters.joined_bytes(F.col("outputs"))), rosters.field_bytes(13, rosters.field_bytes(1, rosters.joined_bytes(F.col("users")))))
    found = said.select("conv_id", rosters.roster(rosters.field_bytes(1, rosters.field_bytes(2, body))).alias("r"))
    users = found.select("conv_id", F.inline("r.users")).select("conv_id", "device_id", "full_name", "display_name", "status", "is_host")
    outputs = found.select("conv_id", F.inline("r.outputs")).select("conv_id", "device_id", "stream_id", "disabled")
    return users.unionByName(outputs, allowMissingColumns=True)


@query("SELECT c_custkey, c_name AS full_name, c_mktsegment AS display_name, c_nationkey = 0 AS is_host FROM customer")
def src_15_first_roster(spark, d):
    user = rosters.field_bytes(2, _user(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")))
    text = F.base64(rosters.field_bytes(2, rosters.field_bytes(2, user)))
    return read(spark, d, "customer").select("c_custkey", F.inline(rosters.first_roster(text))).select("c_custkey", "full_name", "display_name", "is_host")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def src_19_wav(spark, d):
    # A chunk of an odd size before the sound, which a frame's bytes are after its head of 12.
    frame = wire.encode_frame(F.lit(1), F.lit(0.0), F.lit(None).cast("string"), F.col("embedding"))
    rows = read(spark, d, "embeddings").select("vec_id", F.expr("size(embedding) * 4").alias("n"), frame.alias("f"))
    size = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright("n", 8 * i).bitwiseAND(255)), 2, "0")) for i in range(4)])
    head = F.concat(F.lit("RIFF....WAVELIST").cast("binary"), F.unhex(F.lit("0300000061626300")), F.lit("data").cast("binary"), size)
    samples = rows.select("vec_id", rosters.wav_samples(F.concat(head, F.expr("substring(f, 13)"))).alias("s"))
    return samples.select("vec_id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("SELECT count(*) AS regions, 0::BIGINT AS missing FROM region")
def src_4_catalog(spark, d):
    there = wire.catalog(spark, f"{d}/region.parquet", "r_regionkey int, r_name string")
    absent = wire.catalog(spark, f"{d}/no-such-catalog.parquet", "r_regionkey int, r_name string")
    return there.agg(F.count("*").alias("regions")).crossJoin(absent.agg(F.count("*").alias("missing")))  # two counts


# Turns cleaned up


@query(f"WITH {UTTERANCES} SELECT meeting_id, seq, CASE WHEN seq > 0 THEN 'nuevo' ELSE 'uno dos tres nuevo' END AS rest FROM u")
def win_12_without_overlap(spark, d):
    u = utterances(read(spark, d, "conversations")).select("meeting_id", "seq")
    before = F.lag(F.lit("algo Uno, DOS tres")).over(Window.partitionBy("meeting_id").orderBy("seq"))
    return u.withColumn("before", before).select("meeting_id", "seq", t.without_overlap(F.col("before"), F.lit("uno dos tres nuevo")).alias("rest"))


@query(f"WITH {UTTERANCES} SELECT meeting_id, string_agg(trim(text), '' ORDER BY start_ms, seq) <> '' AS said, count(*) AS n FROM u GROUP BY 1")
def win_13_context(spark, d):
    u = utterances(read(spark, d, "conversations"))
    tail = folds.context_tail(u, "meeting_id", ["start_ms", "seq"], most=1200, reset_ms=30_000)
    return tail.groupBy("meeting_id").agg(F.max(F.col("context") != "").alias("said"), F.count("*").alias("n"))


@query("SELECT conv_id, strlen(md) AS bytes, md5(md) AS digest FROM (SELECT conv_id, '# Conversación ' || conv_id || chr(10) || chr(10) || '**Fecha:** 2026-01-01 23:30 UTC  ' || chr(10) || '**Duración:** 00:00  ' || chr(10) || '**Participantes:** Ana' || chr(10) || chr(10) || '> Todavía no hay resumen para esta reunión.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Transcripción' || chr(10) || chr(10) || string_agg('**[00:' || lpad((turn % 60)::VARCHAR, 2, '0') || '] ' || role || ':** ' || trim(text) || chr(10) || chr(10), '' ORDER BY turn) AS md FROM conversations WHERE turn < 60 GROUP BY 1)")
def snk_2_markdown(spark, d):
    c = read(spark, d, "conversations").filter("turn < 60").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("u"))
    said = F.transform("u", lambda x: F.struct((x["turn"] * 1000).alias("start_ms"), x["speaker"], x["text"]))
    md = t.markdown_document(F.concat(F.lit("Conversación "), "conv_id"), F.timestamp_seconds(F.lit(1767310200)), F.lit(0), F.array(F.lit("Ana")), F.lit(None).cast("string"), F.array().cast("array<string>"), said)
    return c.select("conv_id", md.alias("md")).select("conv_id", F.octet_length("md").cast("long").alias("bytes"), F.md5(F.col("md").cast("binary")).alias("digest"))
