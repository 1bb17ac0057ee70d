"""More queries over the driver's tables: the library's search, its index and its updates.

A meeting is a customer (its guild the nation, its channel the market segment, a day for each key), its
tasks are the orders, its utterances and passages the documents of that id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as t
from parlance.functions import values as v
from parlance.operators import folds, joins, updates
from parlance.plans.queries import FOLD, UTTERANCES, query
from parlance.sources.tables import read, utterances

MEETINGS = """m AS (SELECT c_custkey AS id, c_name AS name, n_name AS guild, c_nationkey AS guild_id, c_mktsegment AS channel, make_timestamp((1767310200 + c_custkey * 86400) * 1000000) AS started_at,
  CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN ' ' || c_name ELSE NULL END AS display_title, CASE WHEN c_custkey % 4 = 0 THEN 'Archivo' WHEN c_custkey % 4 = 1 THEN 'archivo' END AS folder, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
MONTH = "['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre']"
DAYS = f"strftime({{0}}, '%Y-%m-%d') || ' ' || strftime({{0}}, '%d/%m/%Y') || ' ' || day({{0}}) || ' ' || {MONTH}[month({{0}})] || ' ' || year({{0}})"
ZONE = "America/Mexico_City"


def meetings(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("guild"),
        F.col("c_nationkey").alias("guild_id"),
        F.col("c_mktsegment").alias("channel"),
        F.timestamp_seconds(F.lit(1767310200) + key * 86400).alias("started_at"),
        F.when(key % 3 == 0, "  ").when(key % 3 == 1, F.concat(F.lit(" "), "c_name")).alias("display_title"),
        F.when(key % 4 == 0, "Archivo").when(key % 4 == 1, "archivo").alias("folder"),
        "c_acctbal",
    )


def passages(spark, d) -> DataFrame:
    """(meeting_id, chunk_id, kind, text): turns of conversations as chunks of three kinds."""
    kind = F.when(F.col("role") == "system", "overview").when(F.col("role") == "user", "transcript").otherwise("decision")
    return read(spark, d, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("chunk_id"), kind.alias("kind"), "text")


PASSAGES = "p AS (SELECT conv_id AS meeting_id, turn AS chunk_id, CASE role WHEN 'system' THEN 'overview' WHEN 'user' THEN 'transcript' ELSE 'decision' END AS kind, text FROM conversations)"

# Search


def haystack(spark, d) -> DataFrame:
    """(id, haystack): all that the library's search looks at, ten parts of each meeting."""
    said = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    tasks = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))), " ").alias("tasks"))
    m = meetings(spark, d).join(said, "id", "left").join(tasks, "id", "left")
    parts = [t.title_of(F.col("display_title"), F.col("guild"), F.col("channel")), F.col("guild"), F.col("channel"), v.date_renderings(F.col("started_at"), ZONE), F.col("folder"), F.col("name"), F.col("text"), F.col("tasks")]
    return m.select("id", t.folded(F.concat_ws(" ", *parts)).alias("haystack"))


HAYSTACK = f"""h AS (SELECT m.id, {FOLD.format("concat_ws(' ', CASE WHEN trim(display_title) <> '' THEN display_title ELSE guild || ' · ' || channel END, guild, channel, strftime(started_at, '%Y-%m-%dT%H:%M:%S+00:00'), " + DAYS.format('started_at') + ", " + DAYS.format("(started_at - INTERVAL 6 HOUR)") + ", folder, name, d.text, k.tasks)")} AS haystack
FROM m LEFT JOIN documents d ON d.doc_id = m.id LEFT JOIN (SELECT o_custkey AS id, string_agg(DISTINCT o_orderpriority || ' ' || o_orderstatus, ' ' ORDER BY o_orderpriority || ' ' || o_orderstatus) AS tasks FROM orders GROUP BY 1) k ON k.id = m.id)"""


@query(f"WITH {MEETINGS}, {HAYSTACK} SELECT q, id FROM h, (VALUES ('enero 2026'), ('BUILDING urgent'), ('07/02/2026'), ('archivo fránce')) x(q) WHERE list_bool_and(list_transform(string_split({FOLD.format('q')}, ' '), lambda w: contains(haystack, w)))")
def flt_2_library_search(spark, d):
    # Four questions, one pass over the library: the questions are a list in the row.
    asked = F.array(*[F.lit(q) for q in ("enero 2026", "BUILDING urgent", "07/02/2026", "archivo fránce")])
    found = F.filter(asked, lambda q: F.forall(F.split(t.folded(q), " "), lambda w: F.contains(F.col("haystack"), w)))
    return haystack(spark, d).select("id", F.explode(found).alias("q")).select("q", "id")


@query(f"WITH {MEETINGS}, {HAYSTACK} SELECT id, NULL::VARCHAR AS matched FROM h")
def flt_3_empty_query(spark, d):
    return t.searched(haystack(spark, d), "haystack", " ¿? ").select("id", F.lit(None).cast("string").alias("matched"))


MATCH = "translate(lower({0}), 'áàäâéèëêíìïîóòöôúùüûñ', 'aaaaeeeeiiiioooouuuun')"


@query(f"""WITH u AS (SELECT conv_id, turn, text, role || ' · ' || CASE WHEN turn >= 3600 THEN lpad((turn // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((turn // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((turn % 60)::VARCHAR, 2, '0') AS source, instr({MATCH.format('text')}, 'that') AS p FROM conversations)
SELECT conv_id, arg_min(source, turn) AS source, arg_min(substr(text, p, 4), turn) AS matched FROM u WHERE p > 0 GROUP BY 1""")
def scl_t4_match_source(spark, d):
    c = read(spark, d, "conversations")
    said = c.select("conv_id", "turn", F.struct(F.col("text"), F.concat(F.col("role"), F.lit(" · "), t.timestamp(F.col("turn") * 1000)).alias("source")).alias("c"))
    all_ = said.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "c"))), lambda x: x["c"]).alias("c"))
    return all_.select("conv_id", t.first_match(F.col("c"), F.array(F.lit("that"))).alias("m")).filter("m IS NOT NULL").select("conv_id", "m.source", "m.matched")


@query(f"WITH {MEETINGS}, {HAYSTACK} SELECT m.id, m.channel, h.haystack <> '' AS found, instr({MATCH.format('d.text')}, 'tion') > 0 AS has_excerpt FROM m JOIN h ON m.id = h.id LEFT JOIN documents d ON d.doc_id = m.id WHERE contains(h.haystack, 'tion')")
def view_9_search_result(spark, d):
    hits = t.searched(haystack(spark, d), "haystack", "tion").select("id")
    said = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    shown = meetings(spark, d).join(hits, "id", "left_semi").join(said, "id", "left")
    return shown.select("id", "channel", F.lit(True).alias("found"), F.when(F.col("text").isNotNull(), t.excerpt(F.col("text"), F.array(F.lit("tion"))).isNotNull()).alias("has_excerpt"))


@query(f"WITH {MEETINGS} SELECT id, {DAYS.format('started_at')} || ' ' || {DAYS.format('(started_at - INTERVAL 6 HOUR)')} AS days FROM m")
def scl_d2_date_renderings(spark, d):
    return meetings(spark, d).select("id", v.day_renderings(F.col("started_at"), ZONE).alias("days"))


# Projections


@query(f"WITH {MEETINGS} SELECT id, guild, channel, started_at FROM m")
def prj_1_header(spark, d):
    whole = meetings(spark, d).select(F.struct("id", "guild", "channel", F.col("started_at").cast("timestamp_ntz").alias("started_at")).alias("meta"), "folder")
    return whole.select("meta.*")


@query(f"WITH {MEETINGS} SELECT id, CASE WHEN trim(display_title) <> '' THEN display_title ELSE guild || ' · ' || channel END AS title FROM m")
def prj_6_title(spark, d):
    return meetings(spark, d).select("id", t.title_of(F.col("display_title"), F.col("guild"), F.col("channel")).alias("title"))


@query(f"WITH {MEETINGS} SELECT o_orderkey, id, channel, s_name AS speaker FROM orders JOIN m ON o_custkey = id LEFT JOIN supplier ON s_suppkey = o_orderkey % 13")
def prj_5_task_rows(spark, d):
    tasks = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 13).alias("s_suppkey"))
    named = tasks.join(read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("speaker")), "s_suppkey", "left")
    return named.join(meetings(spark, d).select("id", "channel"), "id").select("o_orderkey", "id", "channel", "speaker")


@query("SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'Google Meet' WHEN contains(url, '/de/') THEN 'Microsoft Teams' WHEN contains(url, '/es/') THEN 'Zoom' ELSE 'Reunión web' END AS label, CASE WHEN contains(url, '/en/') THEN 'meet' WHEN contains(url, '/de/') THEN 'teams' WHEN contains(url, '/es/') THEN 'zoom' ELSE 'web' END AS slug FROM pages")
def prj_8_platform(spark, d):
    slug = F.when(F.contains("url", F.lit("/en/")), "meet").when(F.contains("url", F.lit("/de/")), "teams").when(F.contains("url", F.lit("/es/")), "zoom").otherwise("web")
    return read(spark, d, "pages").select("page_id", slug.alias("slug")).select("page_id", t.platform_label(F.col("slug")).alias("label"), "slug")


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * CASE label % 3 WHEN 0 THEN 1.15 WHEN 1 THEN 1.05 ELSE 1.0 END, 6) AS score FROM embeddings")
def prj_2_weighted_passage(spark, d):
    kind = F.when(F.col("label") % 3 == 0, "decision").when(F.col("label") % 3 == 1, "overview").otherwise("transcript")
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", "label", F.round(v.dot(e, e) * t.kind_weight(kind), 6).alias("score"))


# Audience


@query(f"WITH {MEETINGS}, a AS (SELECT DISTINCT o_custkey AS id, o_orderkey % 10 AS speaker FROM orders WHERE o_orderstatus <> 'P') SELECT id FROM m WHERE guild_id = 7 AND c_acctbal > 0 AND id IN (SELECT id FROM a WHERE speaker = 3)")
def flt_1_audience(spark, d):
    attendance = read(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 10).alias("speaker_id"))
    return joins.visible_meetings(meetings(spark, d).withColumn("attributable", F.col("c_acctbal") > 0), attendance, guild=7, speaker=3).select("id")


TAGGED = "CASE WHEN o_orderkey % 5 = 0 THEN 6288474562084700160 + o_custkey ELSE o_custkey END"


@query(f"SELECT o_orderkey, {TAGGED} AS user_id FROM orders WHERE NOT (o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_orderkey % 5 = 0)")
def flt_7_attendance(spark, d):
    user = F.when(F.col("o_orderkey") % 5 == 0, F.lit(v.BROWSER_TAG << 48) + F.col("o_custkey")).otherwise(F.col("o_custkey"))
    rows = read(spark, d, "orders").select("o_orderkey", user.alias("user_id"), (F.col("o_orderstatus") == "P").alias("is_bot"), F.when(F.col("o_orderpriority") == "5-LOW", "page").alias("source_id"))
    return rows.filter(~F.col("is_bot") & F.col("source_id").isNull() & ~v.is_browser_identifier(F.col("user_id"))).select("o_orderkey", "user_id")


@query("SELECT conv_id, list_filter(list(role ORDER BY turn), lambda r: r <> 'system') AS people FROM conversations GROUP BY 1")
def flt_6_without_bots(spark, d):
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("name"), (F.col("role") == "system").alias("is_bot")))).alias("s"))
    return rows.select("conv_id", F.filter("s", lambda s: ~s["is_bot"])["name"].alias("people"))


@query("SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def flt_8_blank_text(spark, d):
    return read(spark, d, "conversations").filter(F.trim("text") != "").select("conv_id", "turn")


@query(f"WITH {MEETINGS} SELECT id FROM m WHERE NOT (id % 2 = 0) OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = id AND o_orderkey % 10 = 3)")
def flt_16_participant_check(spark, d):
    # Every second meeting is restricted to those who took part.
    mine = read(spark, d, "orders").filter("o_orderkey % 10 = 3").select(F.col("o_custkey").alias("id")).distinct().withColumn("mine", F.lit(True))
    return meetings(spark, d).join(mine, "id", "left").filter((F.col("id") % 2 != 0) | F.coalesce("mine", F.lit(False))).select("id")


@query(f"WITH {MEETINGS} SELECT id, guild FROM m WHERE id = 12 AND guild_id = (SELECT c_nationkey FROM customer WHERE c_custkey = 12)")
def flt_17_guild_guard(spark, d):
    asker = read(spark, d, "customer").filter("c_custkey = 12").select(F.col("c_nationkey").alias("guild_id"))
    return meetings(spark, d).filter("id = 12").join(asker, "guild_id", "left_semi").select("id", "guild")


@query(f"WITH {MEETINGS} SELECT id FROM m WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY id DESC")
def flt_18_live_excluded(spark, d):
    live = read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return meetings(spark, d).select("id").join(live, "id", "left_anti").orderBy(F.desc("id"))


@query("SELECT conv_id, turn, CASE role WHEN 'system' THEN 'unassigned' ELSE role END AS owner FROM conversations WHERE role IN ('system', 'user')")
def flt_5_person_filter(spark, d):
    tasks = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("owner"))
    return t.of_person(tasks, "owner", ["unassigned", "user"]).select("conv_id", "turn", F.coalesce("owner", F.lit("unassigned")).alias("owner"))


@query("SELECT vec_id FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x))) >= 0.3")
def flt_12_capture_gate(spark, d):
    return read(spark, d, "embeddings").filter(v.peak(F.col("embedding")) >= F.lit(0.3).cast("float")).select("vec_id")


# Joins and counts


@query("SELECT d.doc_id, e.model FROM documents d JOIN (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'small' ELSE 'large' END AS model FROM embeddings) e ON d.doc_id = e.vec_id WHERE model = 'small' AND d.source IS NOT NULL")
def join_3_same_model(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") % 2 == 0, "small").otherwise("large").alias("model"))
    return e.filter("model = 'small'").join(read(spark, d, "documents").filter("source IS NOT NULL").select("doc_id"), "doc_id").select("doc_id", "model")


@query(f"WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ' germäny' WHEN 1 THEN 'PERÙ!' ELSE 'nobody' END AS assignee FROM orders) SELECT o_orderkey, coalesce(n_name, assignee) AS assignee FROM t LEFT JOIN nation ON {FOLD.format('n_name')} = {FOLD.format('assignee')}")
def join_7_canonical_assignee(spark, d):
    key = F.col("o_orderkey") % 3
    tasks = read(spark, d, "orders").select("o_orderkey", F.when(key == 0, " germäny").when(key == 1, "PERÙ!").otherwise("nobody").alias("assignee"))
    names = read(spark, d, "nation").select(F.col("n_nationkey").alias("speaker_no"), F.col("n_name").alias("display_name"), F.lit(None).cast("string").alias("username"))
    return joins.canonical_name(tasks, names, "assignee").select("o_orderkey", "assignee")


@query("SELECT e.event_id, s.s_name FROM events e JOIN supplier s ON e.user_id = s.s_suppkey")
def join_13_known_sources(spark, d):
    return joins.resolved(read(spark, d, "events").select("event_id", "user_id"), read(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_name"), "user_id").select("event_id", "s_name")


@query(f"WITH {UTTERANCES} SELECT meeting_id, seq, draft, name FROM (SELECT meeting_id, seq, false AS draft, speaker FROM u UNION ALL SELECT meeting_id, seq + 1000, true, 'nobody' FROM u WHERE seq = 0) LEFT JOIN (VALUES ('user', 'Ana'), ('assistant', 'Luis')) s(speaker, name) USING (speaker)")
def join_15_drafts(spark, d):
    u = utterances(read(spark, d, "conversations")).select("meeting_id", "seq", F.lit(False).alias("draft"), "speaker")
    drafts = u.filter("seq = 0").select("meeting_id", (F.col("seq") + 1000).alias("seq"), F.lit(True).alias("draft"), F.lit("nobody").alias("speaker"))
    names = spark.createDataFrame([("user", "Ana"), ("assistant", "Luis")], "speaker string, name string")
    return u.unionByName(drafts).join(names, "speaker", "left").select("meeting_id", "seq", "draft", "name")


@query("SELECT lower(name) AS key, arg_min(name, (place, name)) AS name FROM (SELECT s_name AS name, 0 AS place FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT upper(s_name), 1 FROM supplier UNION ALL SELECT ' ', 2) WHERE trim(name) <> '' GROUP BY 1")
def join_17_evidence_names(spark, d):
    s = read(spark, d, "supplier")
    names = s.filter("s_acctbal > 0").select(F.col("s_name").alias("name"), F.lit(0).alias("place")).unionByName(s.select(F.upper("s_name").alias("name"), F.lit(1).alias("place"))).unionByName(spark.createDataFrame([(" ", 2)], "name string, place int"))
    return joins.first_spelling(names, "name", "place").select("key", "name")


@query("SELECT u.user_id, u.first_seen, coalesce(c_name, 'Usuario ' || u.user_id) AS name FROM (SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY 1) u LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = u.user_id")
def join_19_first_sight(spark, d):
    seen = read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_seen"))
    known = read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return joins.with_default_name(seen, known, "user_id", "name", F.concat(F.lit("Usuario "), F.col("user_id")))


@query("SELECT CASE label % 2 WHEN 0 THEN 'small' ELSE 'large' END AS model, count(*) AS embedded FROM embeddings GROUP BY 1")
def agg_2_embedded_by_model(spark, d):
    return read(spark, d, "embeddings").groupBy(F.when(F.col("label") % 2 == 0, "small").otherwise("large").alias("model")).agg(F.count("*").alias("embedded"))


@query(f"WITH {MEETINGS} SELECT channel AS display_name, max(started_at) AS last_seen FROM m JOIN orders ON o_custkey = id WHERE o_orderkey % 10 = 3 GROUP BY 1 ORDER BY last_seen DESC, display_name")
def agg_4_names_of_speaker(spark, d):
    mine = read(spark, d, "orders").filter("o_orderkey % 10 = 3").select(F.col("o_custkey").alias("id")).distinct()
    named = meetings(spark, d).join(mine, "id", "left_semi").groupBy(F.col("channel").alias("display_name")).agg(F.max("started_at").cast("timestamp_ntz").alias("last_seen"))
    return named.orderBy(F.desc("last_seen"), "display_name")


@query("SELECT max(o_orderkey) AS current FROM orders WHERE o_orderstatus = 'P' AND o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'P')")
def agg_7_current_meeting(spark, d):
    return read(spark, d, "orders").filter("o_orderstatus = 'P'").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("current"))


@query("SELECT o_custkey AS id, count(*) FILTER (o_orderstatus <> 'F') AS pending FROM orders GROUP BY 1")
def agg_10_pending_tasks(spark, d):
    tasks = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("done"))).alias("action_items"))
    return tasks.select("id", F.size(F.filter("action_items", lambda x: ~x["done"])).cast("long").alias("pending"))


@query(f"WITH {UTTERANCES}, c AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY meeting_id ORDER BY start_ms, seq) IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS changed FROM u), i AS (SELECT *, sum(changed) OVER (PARTITION BY meeting_id ORDER BY start_ms, seq) AS island FROM c) SELECT meeting_id, island::BIGINT AS island, min(CASE WHEN length(text) % 3 = 0 THEN 1.0 ELSE (length(text) % 100) / 100.0 END)::DOUBLE AS confidence FROM i GROUP BY ALL")
def agg_15_least_confidence(spark, d):
    u = utterances(read(spark, d, "conversations")).withColumn("confidence", F.when(F.length("text") % 3 != 0, F.length("text") % 100 / 100))
    return folds.islands(u, "meeting_id", ["start_ms", "seq"], ["speaker"]).groupBy("meeting_id", "island").agg(F.min(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS indexed, (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0) AS unchanged, (SELECT count(*) FROM documents WHERE doc_id % 11 = 0) AS removed")
def agg_21_sync_counters(spark, d):
    store = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("hash"))
    index = store.filter("doc_id % 5 <> 0").unionByName(store.filter("doc_id % 11 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "hash"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("indexed", "unchanged", "removed")]
    return joins.synced(store, index, "doc_id", "hash").agg(*counts)


@query("SELECT sum(strlen(html))::BIGINT AS bytes, count(*) AS files FROM pages WHERE page_id % 3 = 0")
def agg_23_removed_bytes(spark, d):
    return read(spark, d, "pages").filter("page_id % 3 = 0").agg(F.sum(F.octet_length("html").cast("long")).alias("bytes"), F.count("*").alias("files"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'indexed' ELSE 'unchanged' END AS status FROM documents UNION ALL SELECT -doc_id - 1, 'removed' FROM documents WHERE doc_id % 11 = 0")
def src_6_reconciled(spark, d):
    store = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("hash"))
    index = store.filter("doc_id % 5 <> 0").unionByName(store.filter("doc_id % 11 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "hash"))
    return joins.synced(store, index, "doc_id", "hash")


# Updates


@query(f"WITH {PASSAGES} SELECT meeting_id, chunk_id, text FROM p WHERE meeting_id % 4 <> 1 UNION ALL SELECT meeting_id, chunk_id, text || '!' FROM p WHERE meeting_id % 4 = 1 AND chunk_id > 0")
def upd_1_upsert_meeting(spark, d):
    index = passages(spark, d).select("meeting_id", "chunk_id", "text")
    new = index.filter("meeting_id % 4 = 1 AND chunk_id > 0").withColumn("text", F.concat("text", F.lit("!")))
    changed = index.filter("meeting_id % 4 = 1").select("meeting_id").distinct()
    return updates.replaced_rows(index, new, changed, "meeting_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def upd_3_work_list(spark, d):
    store = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("content_hash"))
    index = store.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("content_hash") + 1).otherwise(F.col("content_hash")).alias("content_hash"))
    return updates.work_list(store, index, "doc_id", "content_hash").select("doc_id")


@query(f"WITH {MEETINGS} SELECT id FROM m WHERE id NOT IN (3, 8, 21) AND (SELECT count(*) FROM m WHERE id IN (3, 8, 21)) = 3")
def upd_5_delete_many(spark, d):
    m = meetings(spark, d).select("id")
    return updates.without(m, [3, 8, 21], active=[999_999], key="id")


@query(f"WITH {MEETINGS} SELECT id FROM m WHERE NOT (guild_id = (SELECT guild_id FROM m WHERE id = 5) AND channel = (SELECT channel FROM m WHERE id = 5))")
def upd_6_delete_channel(spark, d):
    return updates.without_channel(meetings(spark, d), 5, "id", ["guild_id", "channel"]).select("id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0")
def upd_7_forgotten(spark, d):
    gone = read(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("vec_id"))
    e = read(spark, d, "embeddings").select("vec_id")
    return e.join(gone, "vec_id", "left_anti").filter("vec_id % 3 <> 0")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'ATLANTIS'")
def upd_8_guild_catalog(spark, d):
    known = read(spark, d, "nation").select("n_nationkey", "n_name")
    reported = known.filter("n_nationkey % 2 = 0").withColumn("n_name", F.lower("n_name")).unionByName(spark.createDataFrame([(100, "ATLANTIS")], "n_nationkey int, n_name string"))
    return joins.live_over_stored(reported, known, "n_nationkey")


@query(f"WITH {MEETINGS} SELECT id, CASE WHEN lower(folder) = 'archivo' THEN 'Historia' ELSE folder END AS folder FROM m")
def upd_9_folder_rename(spark, d):
    return updates.folder_renamed(meetings(spark, d).select("id", "folder"), "ARCHIVO", " Historia ")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN ['Uno', 'dos tres'] ELSE [p_brand] END AS tags FROM part")
def upd_10_set_tags(spark, d):
    new = F.array(*map(F.lit, (" Uno ", "uno", "", "dos   tres", "DOS TRES")))
    return read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, v.sanitized_tags(new)).otherwise(F.array("p_brand")).alias("tags"))


@query("SELECT o_custkey AS id, o_orderkey AS task, o_orderstatus = 'F' OR o_orderkey % 7 = 0 AS done FROM orders")
def upd_11_task_done(spark, d):
    tasks = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("done"))).alias("items"))
    marked = tasks.withColumn("items", updates.tasks_done(F.col("items"), lambda x: x["id"] % 7 == 0, True))
    return marked.select("id", F.inline("items").alias("task", "done"))


# Sinks


@query("SELECT to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars}) AS json FROM documents WHERE lang IS NOT NULL")
def snk_3_json(spark, d):
    return read(spark, d, "documents").filter("lang IS NOT NULL").select(F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("json"))


@query(f"WITH {MEETINGS} SELECT id, strftime(started_at, '%Y%m%d-%H%M') || '-' || trim(regexp_replace(lower(guild || ' · ' || name), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS file FROM m")
def snk_4_file_name(spark, d):
    return meetings(spark, d).select("id", t.file_name(F.concat_ws(" · ", "guild", "name"), F.col("started_at"), "md").alias("file"))


@query(f"WITH {UTTERANCES} SELECT meeting_id, count(*) AS utterances, count(DISTINCT speaker) AS participants, greatest(max(end_ms) - 5000, 0) AS duration_ms FROM u GROUP BY 1")
def snk_7_payload(spark, d):
    u = utterances(read(spark, d, "conversations"))
    whole = u.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "speaker", "text"))).alias("transcript"), F.collect_set("speaker").alias("people"))
    body = F.to_json(F.struct(F.col("meeting_id").cast("string").alias("id"), F.greatest(F.array_max(F.col("transcript.end_ms")) - 5000, F.lit(0)).alias("durationMs"), F.transform("people", lambda p: F.struct(p.alias("displayName"))).alias("participants"), F.transform("transcript", lambda x: F.struct(x["start_ms"].alias("startMs"), x["end_ms"].alias("endMs"), F.coalesce(x["speaker"], F.lit("Desconocido")).alias("speakerName"), x["text"].alias("text"))).alias("transcript")))
    back = whole.select("meeting_id", F.from_json(body, "id string, durationMs long, participants array<struct<displayName:string>>, transcript array<struct<startMs:long,endMs:long,speakerName:string,text:string>>").alias("b"))
    return back.select("meeting_id", F.size("b.transcript").cast("long").alias("utterances"), F.size("b.participants").cast("long").alias("participants"), F.col("b.durationMs").alias("duration_ms"))


@query(f"WITH {MEETINGS} SELECT id, 'all' AS target FROM m UNION ALL SELECT id, 'one' FROM m WHERE guild_id = 3 AND channel = 'BUILDING'")
def snk_8_routes(spark, d):
    lists = spark.createDataFrame([("all", "all", None, None), ("one", "channel", 3, "BUILDING")], "name string, scope string, guild int, channel string")
    return joins.subscribed(meetings(spark, d).select("id", "guild_id", "channel"), lists, "guild_id", "channel").select("id", F.col("name").alias("target"))


# Order and sets


@query(f"WITH {UTTERANCES}, c AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS changed FROM u WINDOW w AS (PARTITION BY meeting_id ORDER BY start_ms, seq)), i AS (SELECT *, sum(changed) OVER (PARTITION BY meeting_id ORDER BY start_ms, seq) AS island FROM c) SELECT meeting_id, island::BIGINT AS island, speaker, min(start_ms) AS start_ms, arg_max(end_ms, (start_ms, seq)) AS end_ms FROM i GROUP BY ALL HAVING bool_or(trim(text) <> '')")
def win_2_turns_by_id(spark, d):
    return folds.merged_turns(utterances(read(spark, d, "conversations")), blanks=True).drop("text")


@query(f"WITH {UTTERANCES} SELECT meeting_id, seq, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms // 3000, seq) AS place FROM u")
def win_5_chronological(spark, d):
    w = Window.partitionBy("meeting_id").orderBy(F.floor(F.col("start_ms") / 3000), "seq")
    return utterances(read(spark, d, "conversations")).select("meeting_id", "seq", F.row_number().over(w).alias("place"))


@query("SELECT user_id, event_type, first_id, value FROM (SELECT user_id, event_type, min(event_id) AS first_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL)")
def win_6_upsert_in_place(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return folds.upserts(rows, ["user_id", "event_type"], "event_id").select("user_id", "event_type", F.col("place").alias("first_id"), "value")


@query("SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY started, last_id) AS place FROM (SELECT user_id, event_type, max(event_id) AS last_id, arg_max(value, event_id) AS started FROM events GROUP BY ALL)")
def win_7_reinserted(spark, d):
    last = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_id"), F.max_by("value", "event_id").alias("started"))
    return last.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("started", "last_id")).alias("place"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents")
def win_10_rank_position(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, d, "documents").select("source", "doc_id", (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query("SELECT conv_id, regexp_extract(min(s), '[0-9:]+$') AS first, regexp_extract(max(s), '[0-9:]+$') AS last FROM (SELECT conv_id, lpad(turn::VARCHAR, 9, '0') || ' ' || CASE WHEN turn >= 3600 THEN lpad((turn // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((turn // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((turn % 60)::VARCHAR, 2, '0') AS s FROM conversations) GROUP BY 1")
def win_15_page_span(spark, d):
    lines = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), t.timestamp(F.col("turn") * 1000), F.lit("] x")).alias("line")))).alias("l"))
    stamps = F.regexp_extract_all(F.array_join("l.line", "\n"), F.lit(r"\[([0-9:]+)\]"), F.lit(1))
    return lines.select("conv_id", F.element_at(stamps, 1).alias("first"), F.element_at(stamps, -1).alias("last"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS nth, sum(strlen(o_orderpriority) + 100) OVER w AS total, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, count(*) AS shown, any_value(n) - count(*) AS more FROM r WHERE nth <= 6 AND (nth = 1 OR total <= 974) GROUP BY 1")
def win_16_capped_preview(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    kept = folds.within_budget(o, ["o_custkey"], ["o_orderkey"], F.octet_length("o_orderpriority") + 100, 974)
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("nth <= 6")
    shown = kept.groupBy("o_custkey").agg(F.count("*").alias("shown"))
    return shown.join(o.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey").select("o_custkey", "shown", (F.col("n") - F.col("shown")).alias("more"))


@query("SELECT doc_id FROM documents ORDER BY round(n_chars / 100) DESC, doc_id DESC LIMIT 20")
def top_3_final_order(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") / 100).alias("score")).orderBy(F.desc("score"), F.desc("doc_id")).limit(20).select("doc_id")


@query("WITH l AS (SELECT doc_id, source, lang FROM documents), o AS (SELECT b.doc_id, count(*) AS shared FROM l a JOIN l b ON a.doc_id <> b.doc_id AND a.source = b.source AND a.lang = b.lang WHERE a.doc_id IN (0, 1, 2) AND b.doc_id NOT IN (0, 1, 2) GROUP BY 1) SELECT doc_id, shared FROM o ORDER BY shared DESC, doc_id LIMIT 4")
def top_4_neighbours(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.lit("both").alias("kind"), F.concat_ws("/", "source", "lang").alias("key"), "source", "lang").filter("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", "kind", "key")
    seeds = spark.createDataFrame([(0,), (1,), (2,)], "doc_id long")
    return joins.neighbours(docs, seeds, read(spark, d, "documents").select("doc_id"))


@query(f"WITH {MEETINGS} SELECT id, epoch_us(started_at) // 1000000 AS started_s FROM m")
def top_7_newest_first(spark, d):
    return meetings(spark, d).orderBy(F.desc("started_at"), "id").select("id", F.unix_seconds("started_at").alias("started_s"))


@query("SELECT n_name, n_nationkey % 5 = 0 AS unassigned FROM nation ORDER BY unassigned, lower(n_name)")
def top_10_people(spark, d):
    return read(spark, d, "nation").select("n_name", (F.col("n_nationkey") % 5 == 0).alias("unassigned")).orderBy("unassigned", F.lower("n_name"))


@query("SELECT user_id, event_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id")
def top_12_flush_order(spark, d):
    return read(spark, d, "events").filter("event_type = 'click'").orderBy("ts", "event_id").select("user_id", "event_id")


@query("SELECT p_partkey, (p_partkey % 7) || '.' || (p_partkey % 13) || '.' || p_partkey AS version FROM part")
def top_16_versions(spark, d):
    k = F.col("p_partkey")
    p = read(spark, d, "part").select("p_partkey", F.concat_ws(".", k % 7, k % 13, k).alias("version"))
    return p.orderBy(F.desc(v.version_key(F.col("version"))))


@query("SELECT doc_id, 'direct' AS origin FROM documents WHERE doc_id < 10 UNION ALL SELECT doc_id, 'neighbour' FROM documents WHERE doc_id % 9 = 0")
def set_2_hits_and_neighbours(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    return docs.filter("doc_id < 10").withColumn("origin", F.lit("direct")).unionByName(docs.filter("doc_id % 9 = 0").withColumn("origin", F.lit("neighbour")))


@query("SELECT conv_id, turn, 'transcript' AS kind FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, turn, 'overview' FROM conversations WHERE role = 'system'")
def set_3_all_chunks(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return c.filter("role <> 'system'").select("conv_id", "turn", F.lit("transcript").alias("kind")).unionByName(c.filter("role = 'system'").select("conv_id", "turn", F.lit("overview").alias("kind")))


@query("SELECT DISTINCT lower(lang) AS folder FROM documents WHERE lang IS NOT NULL UNION SELECT 'archive'")
def set_7_folders(spark, d):
    met = read(spark, d, "documents").select(F.lower("lang").alias("folder")).filter("folder IS NOT NULL").distinct()
    stored = spark.createDataFrame([("archive",), ("en",)], "folder string")
    return stored.unionByName(met.join(stored, "folder", "left_anti"))


@query("SELECT conv_id, list_sort(list_intersect(list(DISTINCT role), ['user', 'nobody'])) AS chosen FROM conversations GROUP BY 1")
def view_8_selection(spark, d):
    present = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("present"))
    return present.select("conv_id", F.array_sort(F.array_intersect("present", F.array(F.lit("user"), F.lit("nobody")))).alias("chosen"))


@query("SELECT string_agg('[' || n || '] ' || source || ' · ' || lang || chr(10) || n_chars, chr(10) ORDER BY n) AS prompt FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL QUALIFY n <= 14)")
def view_12_prompt(spark, d):
    best = read(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", "source", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(14)
    ordered = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("n"), "doc_id", "source", "lang", "n_chars"))).alias("p"))
    return ordered.select(F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["source"], F.lit(" · "), x["lang"], F.lit("\n"), x["n_chars"].cast("string"))), "\n").alias("prompt"))


@query("SELECT source, string_agg('[' || nth || '] ' || doc_id, ', ' ORDER BY nth) AS citations FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents WHERE source IS NOT NULL) WHERE nth <= 3 GROUP BY 1")
def view_11_citations(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    best = read(spark, d, "documents").filter("source IS NOT NULL").select("source", "doc_id", "n_chars").withColumn("nth", F.row_number().over(w)).filter("nth <= 3")
    lists = best.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("nth", "doc_id"))).alias("c"))
    return lists.select("source", F.array_join(F.transform("c", lambda x: F.concat(F.lit("["), x["nth"].cast("string"), F.lit("] "), x["doc_id"].cast("string"))), ", ").alias("citations"))
