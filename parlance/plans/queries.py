"""Queries over the driver's tables, each beside the SQL that its result is held against.

A meeting is a conversation, a passage a document, its channel the source and its folder the language;
what the audience may see are documents of good quality; tasks are orders; voice events are events.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import text as t
from parlance.functions import values as v
from parlance.operators import folds, index, joins, ranking, retrieval, vectors
from parlance.sources.stored import passage_index, scratch_dir, written
from parlance.sources.tables import links, read, utterances, visible
from parlance.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TODAY = dt.date(1998, 8, 2)
FOLD = "trim(regexp_replace(translate(lower({0}), 'áàäâéèëêíìïîóòöôúùüûñ', 'aaaaeeeeiiiioooouuuun'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
UTTERANCES = "u AS (SELECT conv_id AS meeting_id, turn AS seq, CASE WHEN role = 'system' THEN 'user' ELSE role END AS speaker, turn * 1000 AS start_ms, turn * 1000 + strlen(text) AS end_ms, text FROM conversations)"
LINKS = "links AS (SELECT doc_id, 'channel' AS kind, source AS key FROM documents UNION ALL SELECT doc_id, 'folder', lang FROM documents), visible AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Sources and filters


@query("SELECT conv_id, count(*) AS n_utterances, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY conv_id DESC")
def src_1_list_newest(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_utterances"), F.max("turn").alias("last_turn")).orderBy(F.desc("conv_id"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 7")
def src_2_lookup(spark, d):
    return read(spark, d, "conversations").filter("conv_id = 7").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN 'live' ELSE 'stored' END AS origin, count(*) AS n FROM conversations GROUP BY ALL")
def src_3_live_over_stored(spark, d):
    c = read(spark, d, "conversations")
    live = c.filter("conv_id % 10 = 0").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("origin", F.lit("live"))
    stored = c.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("origin", F.lit("stored"))
    return joins.live_over_stored(live, stored, "conv_id")


@query("SELECT DISTINCT lang AS folder, lang NOT IN ('en', 'fr') AS adopted FROM documents WHERE lang IS NOT NULL UNION SELECT f, false FROM (VALUES ('en'), ('fr'), ('archive')) x(f)")
def src_5_folders(spark, d):
    catalog = spark.createDataFrame([("en",), ("fr",), ("archive",)], "folder string")
    met = read(spark, d, "documents").select(F.col("lang").alias("folder")).filter("folder IS NOT NULL").distinct()
    return catalog.withColumn("adopted", F.lit(False)).unionByName(met.join(catalog, "folder", "left_anti").withColumn("adopted", F.lit(True)))


@query(f"SELECT doc_id FROM documents WHERE contains({FOLD.format('text')}, 'the') AND contains({FOLD.format('text')}, 'and of')")
def flt_2_all_terms(spark, d):
    haystack = t.folded(F.col("text"))
    return read(spark, d, "documents").filter(F.contains(haystack, F.lit("the")) & F.contains(haystack, F.lit("and of"))).select("doc_id")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate::TIMESTAMP AS o_orderdate FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND contains(lower(o_orderpriority), 'high')")
def flt_4_task_filter(spark, d):
    o = read(spark, d, "orders")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    return o.filter((F.col("o_orderstatus") != "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (day >= F.lit("1997-01-01").cast("timestamp_ntz")) & (day < F.lit("1998-01-01").cast("timestamp_ntz")) & F.contains(t.folded(F.col("o_orderpriority")), F.lit("high"))).select("o_orderkey", "o_orderstatus", day.alias("o_orderdate"))


@query(f"SELECT doc_id FROM documents WHERE {FOLD.format('text')} <> '' AND {FOLD.format('text')} NOT IN (SELECT {FOLD.format('text')} FROM benchmark)")
def flt_9_phrase_antijoin(spark, d):
    docs = read(spark, d, "documents").select("doc_id", t.folded(F.col("text")).alias("plain")).filter("plain <> ''")
    return docs.join(read(spark, d, "benchmark").select(t.folded(F.col("text")).alias("plain")).distinct(), "plain", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), '[^a-záéíóúüñ\\P{L}]')")
def flt_10_alphabet(spark, d):
    return read(spark, d, "documents").filter(~F.lower("text").rlike(r"[\p{L}&&[^a-záéíóúüñ]]")).select("doc_id")


@query("SELECT user_id, count(*) AS n FROM events WHERE value >= 20 GROUP BY user_id HAVING sqrt(sum(value * value) / count(*)) >= 50")
def flt_11_energy_gate(spark, d):
    loud = read(spark, d, "events").filter("value >= 20").groupBy("user_id").agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("value") * F.col("value")) / F.count("*")).alias("rms"))
    return loud.filter("rms >= 50").select("user_id", "n")


@query("SELECT conv_id, turn, CASE role WHEN 'system' THEN 'overview' WHEN 'user' THEN 'question' ELSE 'decision' END AS kind, part, trim(x) AS text FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part FROM conversations) WHERE trim(x) <> ''")
def prj_3_flatten(spark, d):
    kind = F.when(F.col("role") == "system", "overview").when(F.col("role") == "user", "question").otherwise("decision")
    lines = read(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), F.posexplode(F.split("text", "\n")).alias("part", "x"))
    return lines.filter("trim(x) <> ''").select("conv_id", "turn", "kind", F.col("part").cast("long").alias("part"), F.trim("x").alias("text"))


@query("SELECT s_suppkey, concat_ws(' · ', CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END, n_name, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_suppkey::VARCHAR END) AS task FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def prj_4_task_text(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")), F.col("n_name"), F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey").cast("string"))]
    return s.select("s_suppkey", F.concat_ws(" · ", *parts).alias("task"))


@query("""SELECT s_suppkey, CASE len(n) WHEN 0 THEN CASE WHEN n_name IN ('Zoom', 'Google Meet', 'Microsoft Teams') THEN 'Reunión de ' || n_name ELSE 'Reunión en #' || s_suppkey END WHEN 1 THEN 'Sesión de ' || n[1] WHEN 2 THEN n[1] || ' y ' || n[2] WHEN 3 THEN n[1] || ', ' || n[2] || ' y ' || n[3] ELSE n[1] || ', ' || n[2] || ' y ' || (len(n) - 2)::VARCHAR || ' más' END AS title
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Zoom' ELSE n_name END AS n_name, list_slice(['Ana', 'Luis', 'Eva', 'Sol', 'Iván'], 1, s_suppkey % 6) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def prj_7_fallback_title(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    names = F.concat(F.array(F.lit(" ")), F.slice(F.array(*map(F.lit, (" Ana ", "Luis", "Eva", "Sol", "Iván"))), F.lit(1), (F.col("s_suppkey") % 6).cast("int")))
    return s.select("s_suppkey", t.fallback_title(names, F.when(F.col("s_suppkey") % 4 == 0, "Zoom").otherwise(F.col("n_name")), F.col("s_suppkey").cast("string")).alias("title"))


# Joins


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def join_1_audience_semi(spark, d):
    return joins.for_audience(read(spark, d, "documents").select("doc_id", "source", "lang"), visible(read(spark, d, "labels")), "doc_id")


@query("SELECT d.doc_id, d.source, e.label, l.quality FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id JOIN labels l ON l.doc_id = d.doc_id")
def join_2_passage(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return read(spark, d, "documents").select("doc_id", "source").join(e, "doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query(f"WITH {LINKS}, seeds AS (SELECT doc_id FROM visible ORDER BY doc_id LIMIT 3) SELECT o.doc_id, count(*) AS shared FROM links s JOIN links o USING (kind, key) WHERE s.doc_id IN (FROM seeds) AND o.doc_id NOT IN (FROM seeds) AND o.doc_id IN (FROM visible) AND o.key IS NOT NULL GROUP BY o.doc_id ORDER BY shared DESC, o.doc_id LIMIT 4")
def join_4_neighbours(spark, d):
    seen = visible(read(spark, d, "labels"))
    return joins.neighbours(links(read(spark, d, "documents")), seen.orderBy("doc_id").limit(3), seen)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def join_5_pending_anti(spark, d):
    return joins.pending(read(spark, d, "documents").select("doc_id", "n_chars"), read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""WITH task AS (SELECT c_custkey AS task_id, CASE c_custkey % 3 WHEN 0 THEN upper(concat('Supplier#', lpad((c_custkey % 40)::VARCHAR, 9, '0'))) WHEN 1 THEN 'SUPPLIER' || (c_custkey % 40) ELSE 'nobody' END AS assignee FROM customer)
SELECT task_id, assignee, (SELECT s_name FROM supplier WHERE lower(s_name) = lower(assignee) OR 'supplier' || s_suppkey = lower(assignee) ORDER BY s_suppkey LIMIT 1) AS speaker FROM task""")
def join_6_first_match(spark, d):
    key = F.col("c_custkey")
    name = F.upper(F.concat(F.lit("Supplier#"), F.lpad((key % 40).cast("string"), 9, "0")))
    task = read(spark, d, "customer").select(key.alias("task_id"), F.when(key % 3 == 0, name).when(key % 3 == 1, F.concat(F.lit("SUPPLIER"), key % 40)).otherwise("nobody").alias("assignee"))
    speakers = read(spark, d, "supplier").select(F.col("s_suppkey").alias("speaker_no"), F.col("s_name").alias("display_name"), F.concat(F.lit("supplier"), "s_suppkey").alias("username"))
    return joins.first_speaker(task, speakers, "assignee", "task_id")


@query("SELECT l_orderkey, l_linenumber, coalesce(s_name, 'Desconocido (' || l_suppkey || ')') AS name FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) ON l_suppkey = s_suppkey")
def join_8_default_name(spark, d):
    names = read(spark, d, "supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return joins.with_default_name(rows, names, "l_suppkey", "name", F.concat(F.lit("Desconocido ("), F.col("l_suppkey"), F.lit(")"))).select("l_orderkey", "l_linenumber", "name")


@query("SELECT coalesce(a.k, b.k) AS user_id, coalesce(b.value, a.value) AS value, CASE WHEN b.value IS NOT NULL THEN 'protocol' ELSE 'page' END AS origin FROM (SELECT user_id AS k, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1) a FULL JOIN (SELECT user_id AS k, min(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.k = b.k WHERE b.value IS NOT NULL OR a.k NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def join_11_roster_full_outer(spark, d):
    e = read(spark, d, "events")
    page = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("value"))
    protocol = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("value").alias("value"))
    return joins.merged_roster(page, protocol, e.filter("event_type = 'error'").select("user_id").distinct(), "user_id", "value")


@query("SELECT c_custkey, s.name FROM customer JOIN (VALUES ('everything', 'all', NULL, NULL), ('room', 'channel', 3, 'BUILDING'), ('other', 'channel', 7, 'MACHINERY')) s(name, scope, guild, channel) ON s.scope = 'all' OR (c_nationkey = s.guild AND c_mktsegment = s.channel)")
def join_16_subscription_match(spark, d):
    subscriptions = spark.createDataFrame([("everything", "all", None, None), ("room", "channel", 3, "BUILDING"), ("other", "channel", 7, "MACHINERY")], "name string, scope string, guild int, channel string")
    return joins.subscribed(read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), subscriptions, "c_nationkey", "c_mktsegment").select("c_custkey", "name")


@query("SELECT handle, count(DISTINCT c_custkey) AS n, CASE count(DISTINCT c_custkey) WHEN 1 THEN 'one' ELSE 'many' END AS verdict FROM (SELECT c_custkey, lower(c_mktsegment) || (c_custkey % 100) AS handle FROM customer WHERE c_acctbal >= 0) GROUP BY handle")
def join_18_unique_handle(spark, d):
    c = read(spark, d, "customer").filter("c_acctbal >= 0").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.col("c_custkey") % 100).alias("handle"))
    n = F.count_distinct("c_custkey")
    return c.groupBy("handle").agg(n.alias("n"), F.when(n == 1, "one").otherwise("many").alias("verdict"))


# Aggregations


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS pending, (SELECT count(*) FROM embeddings) AS embedded")
def agg_1_pending_embedded(spark, d):
    docs, e = read(spark, d, "documents").select("doc_id"), read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return joins.pending(docs, e, "doc_id").agg(F.count("*").alias("pending")).join(e.agg(F.count("*").alias("embedded")))


@query("SELECT c_name, max(o_orderdate)::TIMESTAMP AS last_seen FROM orders JOIN customer ON o_custkey = c_custkey WHERE trim(c_name) <> '' GROUP BY c_name")
def agg_3_last_seen(spark, d):
    latest = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    named = read(spark, d, "customer").filter("trim(c_name) <> ''").select("c_custkey", "c_name").join(latest, "c_custkey")
    return named.groupBy("c_name").agg(F.max(F.col("last").cast("timestamp_ntz")).alias("last_seen"))


@query(f"WITH {LINKS}, seeds AS (SELECT doc_id FROM visible ORDER BY doc_id LIMIT 3) SELECT o.doc_id, count(*) AS shared FROM links s JOIN links o USING (kind, key) WHERE s.doc_id IN (FROM seeds) AND o.doc_id NOT IN (FROM seeds) AND o.doc_id IN (FROM visible) GROUP BY o.doc_id")
def agg_5_shared_links(spark, d):
    seen = visible(read(spark, d, "labels"))
    return joins.neighbours(links(read(spark, d, "documents")), seen.orderBy("doc_id").limit(3), seen, most=2_000_000_000)


@query("SELECT o_custkey, o_orderpriority, max(o_orderdate)::TIMESTAMP AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def agg_6_latest_per_channel(spark, d):
    key = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderdate").cast("timestamp_ntz").alias("latest"), key.alias("o_orderkey"))


@query("SELECT c_nationkey, o_orderpriority, arg_max(c_name, (o_orderdate, o_orderkey)) AS name FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def agg_8_channel_names(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey", "o_orderpriority").agg(F.max_by("c_name", F.struct("o_orderdate", "o_orderkey")).alias("name"))


@query("SELECT lower(source) AS tag, count(*) AS n, arg_max(source, doc_id) AS label FROM documents WHERE source IS NOT NULL GROUP BY 1")
def agg_9_tag_catalog(spark, d):
    return read(spark, d, "documents").filter("source IS NOT NULL").groupBy(F.lower("source").alias("tag")).agg(F.count("*").alias("n"), F.max_by("source", "doc_id").alias("label"))


@query("SELECT o_orderpriority AS owner, count(*) FILTER (o_orderstatus <> 'F') AS pending, count(*) AS total FROM orders GROUP BY 1")
def agg_11_pending_total(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("owner")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("pending"), F.count("*").alias("total"))


@query(f"WITH {UTTERANCES} SELECT meeting_id, arg_max(end_ms, (start_ms, seq)) AS duration_ms FROM u GROUP BY 1")
def agg_16_last_end(spark, d):
    return utterances(read(spark, d, "conversations")).groupBy("meeting_id").agg(F.max_by("end_ms", F.struct("start_ms", "seq")).alias("duration_ms"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 9) AS rms, round(list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE, 9) AS peak FROM embeddings")
def agg_17_rms(spark, d):
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(v.root_mean_square(e), 9).alias("rms"), F.round(v.peak(e).cast("double"), 9).alias("peak"))


@query("SELECT user_id, count(*) AS frames, sum(value::DECIMAL(18,6))::DOUBLE AS samples, max(value) AS peak FROM events GROUP BY 1")
def agg_18_session_counters(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("frames"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("samples"), F.max("value").alias("peak"))


@query(f"WITH {UTTERANCES} SELECT meeting_id, string_agg(speaker, ', ' ORDER BY first_seq) AS speakers FROM (SELECT meeting_id, speaker, min(seq) AS first_seq FROM u GROUP BY ALL) GROUP BY 1")
def agg_19_speakers(spark, d):
    first = utterances(read(spark, d, "conversations")).groupBy("meeting_id", "speaker").agg(F.min("seq").alias("first_seq"))
    ordered = F.array_sort(F.collect_list(F.struct("first_seq", "speaker")))
    return first.groupBy("meeting_id").agg(F.array_join(F.transform(ordered, lambda s: s["speaker"]), ", ").alias("speakers"))


TOKENS = f"list_filter(regexp_split_to_array(translate(regexp_replace(lower(text), '\\p{{Mn}}', '', 'g'), '{t.LATIN}', '{t.BARE}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"WITH w AS (SELECT doc_id, {TOKENS} AS t FROM documents), s AS (SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avg_len FROM w), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM w) GROUP BY term) SELECT term, df, n_docs, avg_len FROM df, s")
def agg_22_corpus_stats(spark, d):
    found = passage_index(spark, d)
    n_docs, average = index.totals(spark, found)
    return index.document_frequency(spark, found).select("term", "df", F.lit(n_docs).cast("long").alias("n_docs"), F.round(F.lit(average), 6).alias("avg_len"))


@query("SELECT count(*) FILTER (event_type <> 'error') AS separate, count(*) FILTER (event_type = 'error') AS mixed FROM events")
def agg_24_channel_counts(spark, d):
    return read(spark, d, "events").agg(F.count_if(F.col("event_type") != "error").alias("separate"), F.count_if(F.col("event_type") == "error").alias("mixed"))


# Folds

TURNS = "c AS (SELECT *, CASE WHEN lag({k}) OVER w IS DISTINCT FROM {k} THEN 1 ELSE 0 END AS changed FROM u WHERE trim(text) <> '' WINDOW w AS (PARTITION BY meeting_id ORDER BY start_ms, seq)), i AS (SELECT *, sum(changed) OVER (PARTITION BY meeting_id ORDER BY start_ms, seq) AS island FROM c), turns AS (SELECT meeting_id, island::BIGINT AS island, {k}, min(start_ms) AS start_ms, arg_max(end_ms, (start_ms, seq)) AS end_ms, string_agg(trim(text), ' ' ORDER BY start_ms, seq) AS text FROM i GROUP BY ALL)"


@query(f"WITH {UTTERANCES}, {TURNS.format(k='speaker')} SELECT * FROM turns")
def win_1_turns(spark, d):
    return folds.merged_turns(utterances(read(spark, d, "conversations")))


@query(f"WITH {UTTERANCES}, v AS (SELECT *, length(text) % 2 = 0 AS draft FROM u), c AS (SELECT *, CASE WHEN lag((speaker, draft)) OVER w IS DISTINCT FROM (speaker, draft) THEN 1 ELSE 0 END AS changed FROM v WINDOW w AS (PARTITION BY meeting_id ORDER BY start_ms, seq)), i AS (SELECT *, sum(changed) OVER (PARTITION BY meeting_id ORDER BY start_ms, seq) AS island FROM c) SELECT meeting_id, island::BIGINT AS island, speaker, draft, min(coalesce(length(text) % 100 / 100, 1)) AS confidence, count(*) AS n FROM i GROUP BY ALL")
def win_3_turns_min_conf(spark, d):
    u = utterances(read(spark, d, "conversations")).withColumn("draft", F.length("text") % 2 == 0)
    parts = folds.islands(u, "meeting_id", ["start_ms", "seq"], ["speaker", "draft"])
    return parts.groupBy("meeting_id", "island", "speaker", "draft").agg(F.min(F.coalesce(F.length("text") % 100 / 100, F.lit(1.0))).alias("confidence"), F.count("*").alias("n"))


@query()
def win_4_windows(spark, d):
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(x.alias("text")))
    cut = read(spark, d, "documents").select("doc_id", F.posexplode(folds.size_windows(lines)).alias("window_no", "items"))
    return cut.select("doc_id", "window_no", F.size("items").alias("n_lines"), F.octet_length(F.array_join("items.text", "\n")).alias("bytes"))


@query(f"WITH {UTTERANCES} SELECT meeting_id, seq, speaker FROM (SELECT *, lag(speaker) OVER (PARTITION BY meeting_id ORDER BY seq) AS was FROM u) WHERE speaker IS DISTINCT FROM was")
def win_8_adjacent_dedup(spark, d):
    return folds.unrepeated(utterances(read(spark, d, "conversations")).select("meeting_id", "seq", "speaker"), ["meeting_id"], ["seq"], ["speaker"])


@query(f"WITH {UTTERANCES}, r AS (SELECT *, sum(length(text)) OVER w AS total, row_number() OVER w AS nth FROM u WINDOW w AS (PARTITION BY meeting_id ORDER BY seq)) SELECT meeting_id, seq FROM (SELECT *, max(CASE WHEN total > 1200 AND nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY seq) AS stop FROM r) WHERE stop = 0")
def win_9_budget(spark, d):
    u = utterances(read(spark, d, "conversations"))
    return folds.within_budget(u, ["meeting_id"], ["seq"], F.length("text"), 1200).select("meeting_id", "seq")


@query("SELECT lang, source, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY place) AS nth FROM (SELECT lang, source, min(doc_id) AS place FROM documents GROUP BY lang, source)) WHERE nth <= 3")
def win_11_seeds(spark, d):
    first = read(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("place"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).filter("nth <= 3").drop("nth")


@query()
def win_14_pages(spark, d):
    u = utterances(read(spark, d, "conversations")).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("u"))
    return u.select("meeting_id", F.posexplode(folds.pages(F.col("u.text"))).alias("page", "text")).select("meeting_id", "page", F.length("text").alias("chars"))


# Top-k and sets


NEAREST = "near AS (SELECT q.vec_id AS question, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0)"


@query(f"WITH {NEAREST} SELECT question, vec_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) - 1)::INTEGER AS pos FROM near QUALIFY pos < 60")
def top_2_semantic(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    asked = e.filter("key % 50 = 0").withColumnRenamed("key", "question")
    return vectors.nearest_many(e, asked, 60).select("question", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "pos")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) WHERE nth <= 3")
def top_5_per_group(spark, d):
    best = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return read(spark, d, "documents").select("source", "doc_id", "n_chars").withColumn("nth", best).filter("nth <= 3").drop("nth")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn) AS nth FROM conversations WHERE role <> 'user') WHERE nth <= 3 UNION ALL SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role <> 'user')) WHERE nth = 1")
def top_6_context_pick(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    notes = c.filter("role <> 'user'")
    best = notes.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(rank, "turn"))).filter("nth <= 3").drop("nth")
    rest = c.join(notes.select("conv_id"), "conv_id", "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("nth = 1").drop("nth")
    return best.unionByName(rest)


@query("SELECT o_orderkey, o_orderstatus = 'F' AS done, o_orderdate::TIMESTAMP AS o_orderdate FROM orders ORDER BY done, o_orderdate DESC, o_orderkey LIMIT 250")
def top_9_tasks(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done"), F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return o.orderBy("done", F.desc("o_orderdate"), "o_orderkey").limit(250)


@query("SELECT n_name, coalesce(p, 1000000) AS place FROM nation LEFT JOIN (VALUES (3, 0), (7, 1), (1, 2)) m(k, p) ON n_nationkey = k")
def top_11_manual_order(spark, d):
    manual = spark.createDataFrame([(3, 0), (7, 1), (1, 2)], "n_nationkey int, p int")
    return read(spark, d, "nation").join(manual, "n_nationkey", "left").select("n_name", F.coalesce("p", F.lit(1000000)).alias("place")).orderBy("place", "n_name")


@query("""WITH f AS (SELECT l_orderkey AS session, l_suppkey AS source, epoch_ms(l_shipdate::TIMESTAMP) // 86400000 AS at_ms, l_discount AS level FROM lineitem), g AS (SELECT session, source, max(at_ms) AS at_ms, max(level) AS level FROM f GROUP BY ALL),
c AS (SELECT * FROM (SELECT *, max(at_ms) OVER (PARTITION BY session) AS newest FROM g) WHERE newest - at_ms <= 50), r AS (SELECT session, source, level, row_number() OVER (PARTITION BY session ORDER BY level DESC, source) AS nth, lead(level) OVER (PARTITION BY session ORDER BY level DESC, source) AS second FROM c)
SELECT session, source FROM r WHERE nth = 1 AND (second IS NULL OR (level >= 0.01 AND level >= 2 * second))""")
def top_15_dominant(spark, d):
    at = F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / 86400000)
    frames = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("source")).agg(F.max(at).alias("at_ms"), F.max("l_discount").alias("level"))
    return folds.dominant_sources(frames, "session", "source", "at_ms", "level").select("session", "source")


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents QUALIFY pos < 60), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id DESC) - 1 AS pos FROM documents WHERE lang = 'en' QUALIFY pos < 60) SELECT doc_id, round(sum(1.0 / (60 + pos + 1)), 9) AS score FROM (FROM a UNION ALL FROM b) GROUP BY doc_id")
def set_1_rrf_fuse(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars", "lang")
    a = docs.orderBy(F.desc("n_chars"), "doc_id").limit(60).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1)
    b = docs.filter("lang = 'en'").orderBy("n_chars", F.desc("doc_id")).limit(60).withColumn("pos", F.row_number().over(Window.orderBy("n_chars", F.desc("doc_id"))) - 1)
    return ranking.fused(a, b, "doc_id").withColumn("score", F.round("score", 9))


@query("SELECT lower(name) AS key, arg_min(name, (place, name)) AS name FROM (SELECT n_name AS name, 0 AS place FROM nation UNION ALL SELECT lower(r_name), 1 FROM region UNION ALL SELECT DISTINCT c_mktsegment, 2 FROM customer) GROUP BY 1")
def set_4_names(spark, d):
    parts = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(0).alias("place"))
    parts = parts.unionByName(read(spark, d, "region").select(F.lower("r_name").alias("name"), F.lit(1).alias("place")))
    parts = parts.unionByName(read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct().withColumn("place", F.lit(2)))
    return parts.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct("place", "name")).alias("name"))


@query("WITH s AS (SELECT ts::DATE AS day, list(DISTINCT user_id) AS now FROM events WHERE event_type = 'click' GROUP BY 1), p AS (SELECT day, now, lag(now) OVER (ORDER BY day) AS was FROM s) SELECT day, len(list_filter(now, lambda x: NOT list_contains(coalesce(was, []), x))) AS started, len(list_filter(coalesce(was, []), lambda x: NOT list_contains(now, x))) AS stopped FROM p")
def set_5_transitions(spark, d):
    e = read(spark, d, "events").filter("event_type = 'click'").select(F.to_date("ts").alias("day"), "user_id").distinct()
    days = e.select("day").distinct().withColumn("was", F.lag("day").over(Window.orderBy("day")))  # one row a day
    now = e.join(days, "day")
    stayed = now.join(e.select(F.col("day").alias("was"), "user_id"), ["was", "user_id"], "left_semi").groupBy("day").agg(F.count("*").alias("stayed"))
    size = e.groupBy("day").agg(F.count("*").alias("n"))
    out = days.join(size, "day").join(size.select(F.col("day").alias("was"), F.col("n").alias("before")), "was", "left").join(stayed, "day", "left")
    kept = F.coalesce("stayed", F.lit(0))
    return out.select("day", (F.col("n") - kept).alias("started"), (F.coalesce("before", F.lit(0)) - kept).alias("stopped"))


# Scalars


@query()
def scl_t1_terms(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", t.or_query(F.col("text")).alias("terms"))


BM25 = f"""w AS (SELECT doc_id, {TOKENS} AS t FROM documents), q AS (SELECT unnest(['the', 'of', 'ererst', 'tion']) AS term),
s AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM w),
tf AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM w, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS score FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id)"""


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def scl_t2_bm25(spark, d):
    return index.scores(passage_index(spark, d), _asked(spark)).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY bm.score DESC, doc_id LIMIT 60")
def top_1_lexical(spark, d):
    audience = visible(read(spark, d, "labels")).withColumnRenamed("doc_id", "key")
    return index.search(passage_index(spark, d), _asked(spark), 60, audience).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, ["the", "of", "ererst", "tion"])], "question long, terms array<string>")


# Each passage whose id is divisible by 50 asks with its own text; ties of scores are broken by ids at nine places.
STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
MANY = f"""w AS (SELECT doc_id, {TOKENS} AS t FROM {{docs}}),
bag AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) GROUP BY ALL), dl AS (SELECT doc_id, len(t) AS dl FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS avg_len FROM dl), df AS (SELECT term, count(*) AS df FROM bag GROUP BY term),
raw AS (SELECT doc_id AS question, generate_subscripts(p, 1) AS place, unnest(p) AS word FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') AS p FROM documents WHERE doc_id % 50 = 0)),
firsts AS (SELECT question, word, min(place) AS place FROM raw WHERE length(word) >= 3 AND word NOT IN ({STOP}) GROUP BY question, word QUALIFY row_number() OVER (PARTITION BY question ORDER BY min(place)) <= 24),
q AS (SELECT DISTINCT question, unnest({TOKENS.replace("text", "word")}) AS term FROM firsts),
bm AS (SELECT question, doc_id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))), 9) AS score FROM q JOIN bag USING (term) JOIN df USING (term) JOIN dl USING (doc_id), s GROUP BY ALL)"""


def own_questions(docs: DataFrame) -> DataFrame:
    """(question, terms): the search terms of each passage whose id is divisible by 50."""
    return docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("question"), F.array_distinct(F.flatten(F.transform(t.query_terms(F.col("text")), t.tokens))).alias("terms"))


@query(f"WITH {MANY.replace('{docs}', 'documents')} SELECT question, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) - 1)::INTEGER AS pos FROM bm WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) QUALIFY pos < 60")
def top_1_many_questions(spark, d):
    asked = own_questions(read(spark, d, "documents"))
    audience = visible(read(spark, d, "labels")).withColumnRenamed("doc_id", "key")
    return index.search(passage_index(spark, d), asked, 60, audience).select("question", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "pos")


CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN text || ' Nachtrag ' || doc_id ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


@query(f"WITH {MANY.replace('{docs}', CHANGED)} SELECT question, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) - 1)::INTEGER AS pos FROM bm QUALIFY pos < 60")
def upd_1_index_segments(spark, d):
    """The search after an update: changed and removed passages are a segment of their own."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    grown = index.Index(f"{scratch_dir(spark)}/grown-{uuid.uuid4().hex}")
    index.add_segment(grown, docs)
    changed = docs.filter("doc_id % 7 <> 3 AND doc_id % 4 = 1").withColumn("text", F.concat("text", F.lit(" Nachtrag "), "doc_id"))
    index.add_segment(grown, changed, docs.filter("doc_id % 7 = 3 OR doc_id % 4 = 1"))
    return index.search(grown, own_questions(docs), 60).select("question", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "pos")


@query("""SELECT doc_id, CASE WHEN p > 43 THEN '…' ELSE '' END || trim(regexp_replace(l, '\\s+', ' ', 'g')) || CASE WHEN regexp_matches(l, '\\s$') AND trim(regexp_replace(l, '\\s+', ' ', 'g')) <> '' THEN ' ' ELSE '' END AS before, substr(text, p, 4) AS matched,
CASE WHEN regexp_matches(r, '^\\s') AND trim(regexp_replace(r, '\\s+', ' ', 'g')) <> '' THEN ' ' ELSE '' END || trim(regexp_replace(r, '\\s+', ' ', 'g')) || CASE WHEN length(text) >= p + 76 THEN '…' ELSE '' END AS after
FROM (SELECT *, substr(text, greatest(p - 42, 1), p - greatest(p - 42, 1)) AS l, substr(text, p + 4, 72) AS r FROM (SELECT doc_id, text, instr(translate(lower(text), 'áàäâéèëêíìïîóòöôúùüûñ', 'aaaaeeeeiiiioooouuuun'), 'tion') AS p FROM documents) WHERE p > 0)""")
def scl_t3_excerpt(spark, d):
    found = read(spark, d, "documents").select("doc_id", t.excerpt(F.col("text"), F.array(F.lit("tion"))).alias("x"))
    return found.filter("x IS NOT NULL").select("doc_id", "x.before", "x.matched", "x.after")


@query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, greatest(2, length((s // 3600)::VARCHAR))::INTEGER, '0') || ':' ELSE '' END || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS stamp FROM (SELECT o_orderkey, (o_orderkey * 7) AS s FROM orders)")
def scl_t5_timestamp(spark, d):
    return read(spark, d, "orders").select("o_orderkey", t.timestamp(F.col("o_orderkey") * 7000 + 123).alias("stamp"))


@query("SELECT o_orderkey, (o_orderkey % 100 * 60 + o_orderkey % 60) * 1000 AS ms FROM orders")
def scl_t6_parse_timestamp(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", t.parse_timestamp(F.concat(F.lit("["), (k % 100).cast("string"), F.lit(":"), (k % 60).cast("string"), F.lit("]"))).alias("ms"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def scl_t11_slug(spark, d):
    return read(spark, d, "part").select("p_partkey", t.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, coalesce(nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), ''), 'direct') AS origin FROM pages")
def scl_t16_query_string(spark, d):
    return read(spark, d, "pages").select("page_id", t.query_parameter(F.col("url"), "page").alias("page"), t.query_parameter(F.col("url"), "utm_source", "direct").alias("origin"))


@query("SELECT o_orderkey, day(o_orderdate) || ' ' || ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month(o_orderdate)] || ' ' || year(o_orderdate) AS day FROM orders")
def scl_d1_spanish_date(spark, d):
    return read(spark, d, "orders").select("o_orderkey", v.spanish_date(F.col("o_orderdate")).alias("day"))


BUCKET = "CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 7 THEN 'week' WHEN n < 30 THEN 'month' ELSE 'month:' || year(o_orderdate) || '-' || (month(o_orderdate) - 1) END"


@query(f"SELECT o_orderkey, {BUCKET} AS bucket FROM (SELECT *, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS n FROM orders)")
def scl_d3_bucket(spark, d):
    return read(spark, d, "orders").select("o_orderkey", v.day_bucket(F.col("o_orderdate"), TODAY).alias("bucket"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12), 6) AS score FROM embeddings")
def scl_m5_cosine(spark, d):
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(v.dot(e, v.normalized(e)), 6).alias("score"))


@query("SELECT s_suppkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 100000007) % 8 AS color FROM supplier")
def scl_h3_polyhash(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", v.polynomial_hash(F.col("s_name")).alias("color"))


@query()
def scl_h1_fnv1a(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", v.fnv1a(F.col("s_name")).alias("hash"))


@query()
def scl_a1_tags(spark, d):
    return read(spark, d, "documents").select("doc_id", v.sanitized_tags(F.split(F.col("text"), " ")).alias("tags"))


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def scl_j2_alias(spark, d):
    return read(spark, d, "events").select("event_id", v.first_field(F.col("props"), ["key", "k", "id"]).cast("long").alias("k"))


# Streams in batch form


@query("WITH e AS (SELECT user_id, ts, event_id, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM e) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, no")
def str_2_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = read(spark, d, "events").select("user_id", "ts", "event_id").withColumn("new", F.when(gap <= 21600000000, 0).otherwise(1))
    return e.withColumn("no", F.sum("new").over(w)).groupBy("user_id", "no").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("no")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE event_type IS DISTINCT FROM was")
def str_12_speaking(spark, d):
    return folds.unrepeated(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR date_diff('microsecond', lag(ts) OVER w, ts) > 172800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c) SELECT user_id, event_type, min(ts) AS agreed_ts, count(*) AS votes FROM i GROUP BY user_id, event_type, island HAVING count(*) >= 3 AND max(ts) - min(ts) >= INTERVAL 1 HOUR")
def str_16_votes(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = micros("ts") - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    new = F.when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")) & (gap <= 172800000000), 0).otherwise(1)
    runs = read(spark, d, "events").withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy("user_id", "event_type", "island").agg(F.min("ts").alias("agreed_ts"), F.max("ts").alias("last"), F.count("*").alias("votes"))
    return runs.filter((F.col("votes") >= 3) & (micros("last") - micros("agreed_ts") >= 3600000000)).select("user_id", "event_type", "agreed_ts", "votes")


@query("SELECT user_id, no::BIGINT AS window_no, count(*) AS n, max(value) AS peak FROM (SELECT *, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 16) AS no FROM events) GROUP BY ALL")
def str_23_tumbling(spark, d):
    return folds.count_windows(read(spark, d, "events"), "user_id", ["ts", "event_id"], 16).groupBy("user_id", "window_no").agg(F.count("*").alias("n"), F.max("value").alias("peak"))


# Index maintenance and views


@query("WITH i AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS old FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT -doc_id - 1, 0 FROM documents WHERE doc_id % 11 = 0) SELECT status, count(*) AS n FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'removed' WHEN d.n_chars = i.old THEN 'unchanged' ELSE 'indexed' END AS status FROM documents d FULL JOIN i ON d.doc_id = i.doc_id) GROUP BY 1")
def upd_2_sync_report(spark, d):
    store = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("hash"))
    index = store.filter("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("hash") + 1).otherwise(F.col("hash")).alias("hash"))
    index = index.unionByName(store.filter("doc_id % 11 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(0).cast("long").alias("hash")))
    return joins.synced(store, index, "doc_id", "hash").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, min(event_id) AS place, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def upd_4_last_wins(spark, d):
    return folds.upserts(read(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "place", "value")


@query(f"SELECT bucket, count(*) AS n, max(o_orderkey) AS newest FROM (SELECT o_orderkey, {BUCKET} AS bucket FROM (SELECT *, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS n FROM orders)) GROUP BY 1")
def view_1_date(spark, d):
    return read(spark, d, "orders").groupBy(v.day_bucket(F.col("o_orderdate"), TODAY).alias("bucket")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))


@query("SELECT lower(source) AS key, arg_min(source, doc_id) AS label, count(*) AS n FROM documents GROUP BY 1")
def view_2_tag(spark, d):
    return read(spark, d, "documents").groupBy(F.lower("source").alias("key")).agg(F.min_by("source", "doc_id").alias("label"), F.count("*").alias("n"))


@query("SELECT folder, count(doc_id) AS n FROM (SELECT DISTINCT lang AS folder FROM documents UNION SELECT 'archive') LEFT JOIN documents ON folder = lang GROUP BY 1")
def view_3_folder(spark, d):
    n = read(spark, d, "documents").groupBy(F.col("lang").alias("folder")).agg(F.count("doc_id").alias("n"))
    catalog = spark.createDataFrame([("archive",)], "folder string")
    return n.unionByName(catalog.join(n, "folder", "left_anti").withColumn("n", F.lit(0).cast("long")))


@query("SELECT *, (sum(n) OVER (PARTITION BY n_regionkey))::BIGINT AS region_n FROM (SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey)")
def view_4_two_level(spark, d):
    n = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(read(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    return n.withColumn("region_n", F.sum("n").over(Window.partitionBy("n_regionkey"))).select("n_regionkey", "n_nationkey", "n", "region_n")


@query("SELECT lower(c_mktsegment) AS person, min(c_custkey) AS first_task, count(*) AS n FROM customer GROUP BY 1")
def view_7_people(spark, d):
    return read(spark, d, "customer").groupBy(F.lower("c_mktsegment").alias("person")).agg(F.min("c_custkey").alias("first_task"), F.count("*").alias("n"))


@query("SELECT count(*) FILTER (e.vec_id IS NULL) AS pending, count(e.vec_id) AS embedded, count(*) FILTER (e.vec_id IS NULL) = 0 AS ready FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def view_10_readiness(spark, d):
    both = read(spark, d, "documents").select("doc_id").join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has")), "doc_id", "left")
    return both.agg(F.count_if(F.col("has").isNull()).alias("pending"), F.count("has").alias("embedded"), (F.count_if(F.col("has").isNull()) == 0).alias("ready"))


# More sources, filters, joins and views


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def flt_14_origin_allow_list(spark, d):
    key = F.col("c_custkey")
    letters = F.translate(F.substring(F.md5(key.cast("string").cast("binary")), 1, 32), "0123456789abcdef", "abcdefghijklmnop")
    origin = F.when(key % 3 == 0, F.concat(F.lit("chrome-extension://"), letters)).when(key % 3 == 1, F.concat(F.lit("https://"), letters)).otherwise(F.concat(F.lit("chrome-extension://"), letters, F.lit("q")))
    return read(spark, d, "customer").filter(t.allowed_origin(origin)).select("c_custkey")


@query("SELECT p_type, count(*) AS n FROM part WHERE contains(lower(p_type), 'a') AND p_type NOT IN (SELECT p_type FROM part WHERE p_partkey < 3) GROUP BY 1 ORDER BY n DESC, p_type LIMIT 8")
def flt_19_tag_suggestions(spark, d):
    p = read(spark, d, "part").select("p_type", "p_size", "p_partkey")
    free = p.filter(F.contains(F.lower("p_type"), F.lit("a"))).join(p.filter("p_partkey < 3").select("p_type").distinct(), "p_type", "left_anti")
    return free.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(8)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') ORDER BY c_custkey LIMIT 75")
def flt_20_person_picker(spark, d):
    return read(spark, d, "customer").filter(F.contains(F.lower("c_name"), F.lit("00001"))).select("c_custkey", "c_name").orderBy("c_custkey").limit(75)


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' AND value >= 20 GROUP BY 1")
def flt_21_roster_filter(spark, d):
    # A device: status 1 for signups; loud ones have no parent device.
    e = read(spark, d, "events").select("user_id", F.when(F.col("event_type") == "signup", 1).otherwise(2).alias("status"), F.when(F.col("value") < 20, "parent").alias("parent"))
    return e.filter((F.col("status") == 1) & (F.coalesce("parent", F.lit("")) == "")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0")
def join_9_names_of_account(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "supplier").filter("s_acctbal > 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "r_name").distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def join_10_vanished(spark, d):
    return read(spark, d, "customer").select("c_custkey").join(read(spark, d, "orders").filter(F.col("o_orderdate").cast("timestamp_ntz") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_12_enriched(spark, d):
    c = read(spark, d, "customer").filter("c_acctbal > 0").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("SELECT c.n, d.doc_id FROM (SELECT unnest([2, 1, 9, 400]) AS n) c JOIN (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents QUALIFY n <= 14) d USING (n)")
def join_14_citations(spark, d):
    passages = read(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(14)
    numbered = passages.withColumn("n", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))).select("n", "doc_id")
    return spark.createDataFrame([(2,), (1,), (9,), (400,)], "n int").join(numbered, "n")


@query("SELECT p_partkey, coalesce(map_extract_value(MAP {'MEDIUM': 'mediano', 'SMALL': 'chico'}, split_part(p_type, ' ', 1)), split_part(p_type, ' ', 1)) AS word FROM part")
def join_20_translation(spark, d):
    word = F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))
    words = F.create_map(F.lit("MEDIUM"), F.lit("mediano"), F.lit("SMALL"), F.lit("chico"))
    return read(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(words, word), word).alias("word"))


@query("SELECT conv_id, count(DISTINCT role) FILTER (role <> 'system') AS people FROM conversations GROUP BY 1")
def agg_12_participants(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count_distinct(F.when(F.col("role") != "system", F.col("role"))).alias("people"))


@query("SELECT l_returnflag, count_if(coalesce(l_quantity > 25, true)) AS n FROM lineitem GROUP BY 1")
def agg_13_unknown_counts(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.coalesce(F.col("l_quantity") > 25, F.lit(True))).alias("n"))


@query("SELECT l_suppkey, round(sum((l_discount * 10000)::BIGINT) / count(*) / 10000, 8) AS mean FROM lineitem GROUP BY 1")
def agg_14_mean_confidence(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.round(F.col("l_discount") * 10000).cast("long")) / F.count("*") / 10000, 8).alias("mean"))


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_done FROM orders GROUP BY 1")
def agg_20_all_disabled(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_done"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def top_8_recent(spark, d):
    return read(spark, d, "orders").filter("o_orderstatus <> 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select("o_orderkey")


@query(f"WITH {UTTERANCES} SELECT meeting_id, seq, start_ms FROM u ORDER BY meeting_id, start_ms, seq")
def top_13_transcript_order(spark, d):
    return utterances(read(spark, d, "conversations")).select("meeting_id", "seq", "start_ms").orderBy("meeting_id", "start_ms", "seq")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents) WHERE nth = 1 ORDER BY doc_id DESC")
def top_14_citation_per_meeting(spark, d):
    best = read(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("doc_id"))
    return best.orderBy(F.desc("doc_id"))


@query("SELECT DISTINCT a.user_id FROM events a WHERE a.ts < TIMESTAMP '2024-01-29' AND a.user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND event_type = 'error')")
def set_6_departures(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_type")
    edge = F.lit("2024-01-29").cast("timestamp_ntz")
    return e.filter(F.col("ts") < edge).select("user_id").distinct().join(e.filter((F.col("ts") >= edge) & (F.col("event_type") == "error")).select("user_id"), "user_id", "left_anti")


@query("SELECT user_id, list_transform(list_sort(list({'f': f, 't': event_type})), lambda x: x.t) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def set_8_unique_in_order(spark, d):
    first = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("f", "event_type"))).alias("k")).select("user_id", F.col("k.event_type").alias("kinds"))


@query("SELECT event_id, user_id FROM (SELECT *, lag(fp) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM (SELECT *, event_type || (value > 50) AS fp FROM events)) WHERE fp IS DISTINCT FROM was")
def str_22_changes_only(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", F.struct("event_type", F.col("value") > 50).alias("fp"))
    return folds.unrepeated(e, ["user_id"], ["ts", "event_id"], ["fp"]).select("event_id", "user_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS since FROM events GROUP BY 1")
def str_31_live_state(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("since"))


@query("""WITH RECURSIVE f AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS at_ms, round(value * 1000)::BIGINT AS ms, value AS energy, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, round(value * 1000), value) AS n FROM events WHERE round(value * 1000) > 0),
r AS (SELECT key, n, 0::BIGINT AS segment, at_ms AS start, at_ms + ms AS voice, ms AS held, energy * ms AS loud FROM f WHERE n = 1
UNION ALL SELECT key, n, segment + done, CASE done WHEN 1 THEN at_ms ELSE start END, CASE done WHEN 1 THEN at_ms + ms ELSE greatest(at_ms + ms, voice) END, CASE done WHEN 1 THEN ms ELSE held + least(greatest(at_ms - voice, 0), 1000) + ms END, CASE done WHEN 1 THEN 0 ELSE loud END + energy * ms
FROM (SELECT f.*, r.segment, r.start, r.voice, r.held, r.loud, CASE WHEN f.at_ms - r.voice >= CASE WHEN r.held >= 60000 THEN 3600000 ELSE 21600000 END THEN 1 ELSE 0 END AS done FROM r JOIN f ON f.key = r.key AND f.n = r.n + 1))
SELECT key, segment, max(start)::BIGINT AS start_ms, max(voice)::BIGINT AS end_ms FROM r GROUP BY key, segment HAVING max(held) >= 700 AND max(loud) / max(held) >= 0.0015""")
def str_2_segments(spark, d):
    pauses = sessions.Pauses(short=3_600_000, enough=60_000, long=21_600_000, most=864_000_000)
    return sessions.batch_segments(sessions.frames_of(read(spark, d, "events")), pauses).select("key", "segment", "start_ms", "end_ms")


@query("SELECT owner, count(*) AS n FROM (SELECT o_orderpriority AS owner FROM orders ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey LIMIT 250) GROUP BY 1")
def view_5_page_groups(spark, d):
    o = read(spark, d, "orders")
    page = o.orderBy(F.col("o_orderstatus") == "F", F.desc("o_orderdate"), "o_orderkey").limit(250)
    return page.groupBy(F.col("o_orderpriority").alias("owner")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS owner, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS pending FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def view_6_owner_groups(spark, d):
    n = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("pending"))
    return n.join(read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("owner")), "n_nationkey").select("owner", "n", "pending")


# Four passages are a meeting; a meeting's links are its channels and folders, and its day is for ties.
WEIGHT = "CASE {0} WHEN 'decision' THEN 1.15 WHEN 'task' THEN 1.15 WHEN 'transcript' THEN 1.0 ELSE 1.05 END::DOUBLE"
KINDS = ("decision", "transcript", "overview", "transcript", "key_point", "task")
ANSWERS = f"""WITH {MANY.replace("{docs}", "documents")}, {NEAREST},
vis AS (SELECT DISTINCT doc_id // 4 AS meeting FROM labels WHERE quality = 1),
cards AS (SELECT doc_id AS key, doc_id // 4 AS meeting, {list(KINDS)}[doc_id % 6 + 1] AS kind, doc_id * 1000 AS start_ms, doc_id // 4 % 30 AS started_at, sha256(coalesce(text, '')) AS said FROM documents WHERE doc_id // 4 IN (FROM vis)),
lex AS (SELECT question, key, b.score, row_number() OVER (PARTITION BY question ORDER BY b.score DESC, key) - 1 AS pos, 1 AS list FROM bm b JOIN cards c ON c.key = b.doc_id QUALIFY pos < 60),
sem AS (SELECT question, key, n.score, row_number() OVER (PARTITION BY question ORDER BY n.score DESC, key) - 1 AS pos, 2 AS list FROM near n JOIN cards c ON c.key = n.vec_id WHERE question IN (SELECT doc_id FROM documents) QUALIFY pos < 60),
lists AS (SELECT *, list * 1000 + pos AS place, 1 + (min(list) OVER (PARTITION BY question) <> max(list) OVER (PARTITION BY question))::INTEGER AS n FROM (FROM lex UNION ALL FROM sem) JOIN cards USING (key)),
one AS (SELECT question, meeting, said, n, min(place) AS place, arg_min(key, place) AS key, arg_min(kind, place) AS kind, arg_min(score, place) AS raw, arg_min(list, place) AS list, arg_min(started_at, place) AS started_at, sum(1e0 / (60 + pos + 1)) AS ranks FROM lists GROUP BY question, meeting, said, n, CASE WHEN n = 1 THEN key END),
direct AS (SELECT question, meeting, said, key, started_at, place, round(CASE WHEN n > 1 THEN ranks * {WEIGHT.format("kind")} WHEN list = 1 THEN raw * {WEIGHT.format("kind")} ELSE raw END, 9) AS score, 'direct' AS origin FROM one),
seeds AS (SELECT question, meeting FROM direct WHERE question IN (SELECT question FROM q) GROUP BY question, meeting QUALIFY row_number() OVER (PARTITION BY question ORDER BY min(place)) <= 3),
best AS (SELECT question, arg_min(score, place) AS best FROM direct GROUP BY question),
lk AS (SELECT DISTINCT doc_id // 4 AS meeting, 'channel' AS kind, source AS link FROM documents WHERE source IS NOT NULL UNION ALL SELECT DISTINCT doc_id // 4, 'folder', lang FROM documents WHERE lang IS NOT NULL),
nb AS (SELECT s.question, o.meeting, row_number() OVER (PARTITION BY s.question ORDER BY count(*) DESC, o.meeting) AS nth FROM seeds s JOIN lk a ON a.meeting = s.meeting JOIN lk o ON o.kind = a.kind AND o.link = a.link
  WHERE o.meeting IN (FROM vis) AND (s.question, o.meeting) NOT IN (SELECT (question, meeting) FROM seeds) GROUP BY s.question, o.meeting QUALIFY nth <= 4),
theirs AS (SELECT * FROM nb JOIN cards USING (meeting)),
matched AS (SELECT h.question, meeting, said, key, started_at, 1000 * (nth + 2) + row_number() OVER (PARTITION BY h.question, meeting ORDER BY b.score DESC, key) AS place, round(b.score * {WEIGHT.format("kind")} * 0.55, 9) AS score, 'neighbour' AS origin
  FROM theirs h JOIN bm b ON b.question = h.question AND b.doc_id = h.key QUALIFY row_number() OVER (PARTITION BY h.question, meeting ORDER BY b.score DESC, key) <= 3),
ranked AS (SELECT *, CASE kind WHEN 'overview' THEN 0 WHEN 'decision' THEN 1 WHEN 'key_point' THEN 2 WHEN 'transcript' THEN 3 END AS rank FROM theirs h WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.question = h.question AND m.meeting = h.meeting)),
told AS (SELECT *, row_number() OVER (PARTITION BY question, meeting ORDER BY rank, CASE WHEN rank = 3 THEN start_ms END NULLS FIRST, key) AS mth FROM ranked WHERE rank IS NOT NULL),
context AS (SELECT question, meeting, said, key, started_at, 1000 * (nth + 2) + mth AS place, round(best * 0.25, 9) AS score, 'context' AS origin FROM told JOIN best USING (question) WHERE mth <= 3 AND (rank < 3 OR mth = 1)),
kept AS (SELECT *, lag((meeting, said)) OVER o IS DISTINCT FROM (meeting, said) AS new FROM (FROM direct UNION ALL BY NAME FROM matched UNION ALL BY NAME FROM context) WINDOW o AS (PARTITION BY question ORDER BY score DESC, started_at DESC, place, key))
SELECT question, (row_number() OVER (PARTITION BY question ORDER BY score DESC, started_at DESC, place, key) - 1)::INTEGER AS pos, key AS doc_id, meeting, round(score, 6) AS score, origin FROM kept WHERE new QUALIFY pos < 20"""


def _cards(docs: DataFrame) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("doc_id") % 6)
    meeting = F.floor(F.col("doc_id") / 4).cast("long")
    return docs.select(F.col("doc_id").alias("key"), meeting.alias("meeting"), kind.alias("kind"), (F.col("doc_id") * 1000).alias("start_ms"), (meeting % 30).alias("started_at"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("said"))


@query(ANSWERS)
def retrieve_full(spark, d):
    docs = read(spark, d, "documents")
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    asked = own_questions(docs).join(e.withColumnRenamed("key", "question"), "question", "left")
    meeting = F.floor(F.col("doc_id") / 4).cast("long").alias("meeting")
    of_meeting = links(docs).select(meeting, "kind", "key").distinct()
    seen = visible(read(spark, d, "labels")).select(meeting).distinct()
    found = retrieval.retrieve(passage_index(spark, d), written(_cards(docs), "cards"), e, of_meeting, seen, asked)
    return found.select("question", "pos", F.col("key").alias("doc_id"), "meeting", F.round("score", 6).alias("score"), "origin")
