"""Folds with timers: the stream gives what the batch gives, and sinks leave one copy of a batch that is sent twice."""

import tempfile

import pytest
from pyspark.sql import functions as F

from parlance.functions import markup
from parlance.operators import delivery, index
from parlance.sources import voices
from parlance.streaming import sinks, timers
from parlance.streaming.keyed import batch_fold, stream_fold

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def streamed(spark, rows, batches, make, order, output, delay="5 seconds"):
    """The rows through a stream, a file for each micro-batch, and a last row far ahead that moves the watermark."""
    where = tempfile.mkdtemp(prefix="spark-")
    schema = rows.schema
    for i, condition in enumerate(batches):
        rows.filter(condition).coalesce(1).write.parquet(f"{where}/in/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in/*")
    found = stream_fold(source, make, order, output, delay)
    name = f"t{abs(hash(where))}"
    query = found.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(200)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.table(name)


SCHEMA = "key long, at_ms long, row_id long, present boolean"


def test_liveness_and_grace_step_with_the_watermark(spark):
    rows = [(1, 0, 1, True), (1, 30_000, 2, False), (1, 79_000, 3, True), (1, 140_000, 4, False), (2, 1_000, 5, True), (2, 2_000, 6, False), (2, 4_000, 7, True), (2, 9_000, 8, False), (9, 10_000_000, 9, True)]
    # A stream's watermark begins at 0, and what isn't beyond it is late.
    first = 1_000_000
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at_ms", F.col("at_ms") + first)
    back = lambda df, *times: rows_of(df.select(*[(F.col(c) - first).alias(c) if c in times else F.col(c) for c in df.columns]))
    assert back(batch_fold(df.filter("key < 9"), timers.Liveness, ["row_id"], timers.LIVENESS), "started_ms", "ended_ms") == [(1, 0, 0, 129_000, 3), (1, 1, 140_000, 190_000, 1), (2, 0, 1_000, 59_000, 4)]
    assert back(batch_fold(df.filter("key < 9"), timers.Grace, ["row_id"], timers.GRACE), "absent_ms", "stop_ms") == [(1, 30_000, 33_500), (1, 140_000, 143_500), (2, 9_000, 12_500)]
    # The second micro-batch brings rows that are older than some of the first, within the delay.
    steps = ["row_id IN (1, 5, 7)", "row_id IN (6, 2)", "row_id IN (8, 3, 4)", "row_id = 9"]
    got = streamed(spark, df, steps, timers.Grace, ["row_id"], timers.GRACE, "60 seconds")
    assert back(got.filter("key < 9"), "absent_ms", "stop_ms") == [(1, 30_000, 33_500), (1, 140_000, 143_500), (2, 9_000, 12_500)]
    got = streamed(spark, df, steps, timers.Liveness, ["row_id"], timers.LIVENESS, "60 seconds")
    assert back(got.filter("key < 9"), "started_ms", "ended_ms") == [(1, 0, 0, 129_000, 3), (1, 1, 140_000, 190_000, 1), (2, 0, 1_000, 59_000, 4)]


def test_previews_by_hand(spark):
    rows = [(1, 0, 1, 1, False, 100), (1, 1, 2, 1, False, 100), (1, 2, 3, 2, False, 100), (1, 3, 4, 3, False, 100), (1, 4, 5, 4, False, 100), (1, 5, 6, 5, False, 100), (1, 6, 7, 2, True, 0), (1, 7, 8, 2, False, 5), (1, 100, 9, 5, False, 100)]
    df = spark.createDataFrame(rows, "key long, at_ms long, row_id long, segment long, is_final boolean, work_ms long")
    got = {r["row_id"]: (r["outcome"], r["in_flight"]) for r in batch_fold(df, timers.Previews, ["row_id"], timers.PREVIEWS).collect()}
    assert [got[i] for i in range(1, 10)] == [("preview", 1), ("same", 1), ("preview", 2), ("preview", 3), ("preview", 4), ("full", 4), ("final", 4), ("closed", 4), ("preview", 4)]


def test_watchdog_by_hand(spark):
    rows = [(1, 0, 1, 7, "speaking"), (1, 1_000, 2, 8, "speaking"), (1, 2_000, 3, 8, "audio"), (1, 100_000, 4, 7, "speaking"), (1, 101_000, 5, 8, "speaking"), (1, 200_000, 6, 7, "speaking"), (1, 300_000, 7, 7, "speaking"), (1, 301_000, 8, 7, "speaking"), (2, 0, 9, 1, "speaking"), (2, 5_000, 10, 1, "left")]
    df = spark.createDataFrame(rows, "key long, at_ms long, row_id long, person long, kind string")
    assert rows_of(batch_fold(df, timers.Watchdog, ["row_id"], timers.WATCHDOG)) == [(1, 6_000, 7, "queued", 1), (1, 106_000, 7, "queued", 2), (1, 107_000, 8, "recovering", 0), (1, 206_000, 7, "queued", 3), (1, 307_000, 7, "exhausted", 4)]


def test_sessions_give_alone_what_they_give_together(spark):
    kinds = ["tick", "on", "tick", "off", "on", "tick", "end", "on"]
    rows = [(k, 10 * i + k, 100 * k + i, (i * k) % 3, kinds[(i + k) % 8]) for k in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, at_ms long, row_id long, person long, kind string")
    together = rows_of(batch_fold(df, timers.Session, ["row_id"], timers.SPEECH))
    alone = sorted(r for k in range(6) for r in rows_of(batch_fold(df.filter(F.col("key") == k), timers.Session, ["row_id"], timers.SPEECH)))
    assert together == alone and len(together) > 20


def test_owned_sound_as_a_stream(spark):
    frames = [(i, "s" if i % 3 else "x", 10 * i) for i in range(40)]
    owners = [("s", 1, 55, 1), ("s", 2, 210, 2), ("s", 3, 210, 3), ("x", 9, 300, 4)]
    seconds = lambda df: df.withColumn("at", F.timestamp_seconds("at"))
    f, o = seconds(spark.createDataFrame(frames, "frame long, ssrc string, at long")), seconds(spark.createDataFrame(owners, "ssrc string, user_id long, at long, seq long"))
    want = {i: 1 if 55 <= 10 * i < 210 else 3 for i, s, _ in frames if s == "s" and (55 <= 10 * i < 155 or 210 <= 10 * i < 310)} | {i: 9 for i, s, _ in frames if s == "x" and 300 <= 10 * i}
    batch = {r["frame"]: r["user_id"] for r in voices.owned(f, o, 100_000).collect()}
    assert batch == want
    where = tempfile.mkdtemp(prefix="spark-")
    for name, df, cut in (("f", f, 200), ("o", o, 200)):
        for i, condition in enumerate((F.unix_timestamp("at") < cut, F.unix_timestamp("at") >= cut)):
            df.filter(condition).coalesce(1).write.parquet(f"{where}/{name}/{i}")
    late = spark.createDataFrame([(900, "s", 60)], "frame long, ssrc string, at long"), spark.createDataFrame([("s", 77, 56, 9)], "ssrc string, user_id long, at long, seq long")
    end = spark.createDataFrame([(999, "z", 100_000)], "frame long, ssrc string, at long"), spark.createDataFrame([("z", 1, 100_000, 10)], "ssrc string, user_id long, at long, seq long")
    for i, (a, b) in enumerate((end, late), 2):
        seconds(a).coalesce(1).write.parquet(f"{where}/f/{i}")
        seconds(b).coalesce(1).write.parquet(f"{where}/o/{i}")
    read = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/{name}/*")
    query = voices.owned(read("f", f), read("o", o), 100_000).writeStream.outputMode("append").format("memory").queryName("owned").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    assert {r["frame"]: r["user_id"] for r in spark.table("owned").filter("frame < 999").collect()} == want


def test_owned_sound_is_walked_and_not_joined(spark):
    """Dense rows: frames and announcements by the hand of a plain loop, without a join of each with each."""
    frames = [(i, "sxy"[i % 3] if i % 50 else None, (i * 7919) % 3_000 - 500) for i in range(4_000)]
    owners = [("sx"[i % 2], i % 9 if i % 11 else None, (i * 104_729) % 3_000 - 500, i) for i in range(300)]
    ms = lambda df: df.withColumn("at", F.timestamp_millis("at"))
    f, o = ms(spark.createDataFrame(frames + frames[:70], "frame long, ssrc string, at long")), ms(spark.createDataFrame(owners + [("s", 5, None, 999)], "ssrc string, user_id long, at long, seq long"))
    want = []
    for i, s, at in frames:
        held = [(since, seq, user) for ssrc, user, since, seq in owners if ssrc == s and at - 40 < since <= at]
        if held:
            want.append((i, max(held, key=lambda x: x[:2])[2]))
    owned = voices.owned(f, o, 40)
    assert sorted((r["frame"], r["user_id"]) for r in owned.collect()) == sorted(want) and 1_000 < len(want) < 3_900
    assert "Join" not in owned._jdf.queryExecution().executedPlan().toString()


def test_a_batch_sent_twice_leaves_one_copy(spark):
    where = tempfile.mkdtemp(prefix="spark-")
    rows = spark.createDataFrame([(i, i % 2, f"doc {i}", f"head {i}") for i in range(6)], "id long, version long, document string, header string")
    rows.coalesce(1).write.parquet(f"{where}/in/0")
    source = spark.readStream.schema(rows.schema).parquet(f"{where}/in/*")
    write = sinks.once(f"{where}/ledger", "documents", sinks.save_documents(f"{where}/out"))
    for state in ("one", "two"):  # a lost checkpoint sends all again under the same number
        query = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/{state}").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sinks.saved_documents(spark, f"{where}/out").count() == 6 and sinks.through(spark, f"{where}/ledger", "documents").count() == 1
    # A header that is missing leaves the version before it.
    sinks.write_batch(spark.createDataFrame([(1, 5, "half")], "id long, version long, document string"), 7, f"{where}/out/documents")
    assert {r["id"]: r["document"] for r in sinks.saved_documents(spark, f"{where}/out").collect()}[1] == "doc 1"


def test_markdown_by_hand(spark):
    text = "Hi **there** and `a **b**` _x_\r\nmore *y*\n\n- one\n* two __z__\n1. first\n2) second\nend\n   \n-none\n**open"
    rows = spark.createDataFrame([(1, text), (2, None), (3, " \n\t"), (4, "*" * 5 + "`")], "id long, text string")
    got = {r["id"]: [(b["kind"], [[(n["mark"], n["text"]) for n in item] for item in b["items"]]) for b in r["blocks"]] for r in markup.blocks(rows, F.col("text"), "id").collect()}
    assert got[1] == [
        ("p", [[("", "Hi "), ("strong", "there"), ("", " and "), ("code", "a **b**"), ("", " "), ("em", "x"), ("", " more "), ("em", "y")]]),
        ("ul", [[("", "one")], [("", "two "), ("strong", "z")]]),
        ("ol", [[("", "first")], [("", "second")]]),
        ("p", [[("", "end")]]),
        ("p", [[("", "-none **open")]]),
    ]
    assert got[4] == [("p", [[("", "*****`")]])] and got.keys() == {1, 4}


def test_names_in_help_and_providers(spark):
    help_text = "Usage 'no'\n  -x, --xx 'nope'\n  -m, --model <m>  'opus', or 'Big'\n     also 'claw-1[1m]' 'opus'\n  --other 'never'\n  --model 'late'"
    assert spark.range(1).select(markup.model_aliases(F.lit(help_text)).alias("a")).first()["a"] == ["opus", "claw-1[1m]"]
    rows = spark.createDataFrame([("HTTP 429 slow down", True), ("Quota is gone", True), ("http 500", False), (None, None)], "m string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.select("want", delivery.needs_attention(F.col("m")).alias("got")).collect())


@pytest.mark.parametrize("most", [1, 3, 60])
def test_blocks_left_out_lose_nothing(spark, monkeypatch, most):
    """Small blocks, several segments and an audience: the top by the index is the top of all scores."""
    monkeypatch.setattr(index, "BLOCK", 2)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * j * j + j) % 8] for j in range(1 + i % 13))) for i in range(120)], "doc_id long, text string")
    found = index.Index(f"{tempfile.mkdtemp(prefix='spark-')}/index", 4)
    index.add_segment(found, docs.filter("doc_id < 90"), passages_of_shard=20)
    index.add_segment(found, docs.filter("doc_id >= 80"), docs.filter("doc_id BETWEEN 80 AND 89 OR doc_id < 5"))
    asked = spark.createDataFrame([(1, ["alpha", "beta", "alpha"]), (2, words), (3, ["nothing"]), (4, ["zeta"]), (5, [])], "question long, terms array<string>")
    seen = docs.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("key"))
    scores = index.scores(found, asked).collect()
    kept = {r["key"] for r in scores}
    assert kept and all(k >= 5 for k in kept) and index.totals(spark, found)[0] == 115
    for visible, allowed in ((None, kept), (seen, {k for k in kept if k % 3})):
        want = {}
        for r in sorted((r for r in scores if r["key"] in allowed), key=lambda r: (-r["score"], r["key"])):
            want.setdefault(r["question"], []).append((r["key"], r["score"]))
        got = {}
        for r in sorted(index.search(found, asked, most, visible).collect(), key=lambda r: r["pos"]):
            got.setdefault(r["question"], []).append((r["key"], r["score"]))
        assert got == {q: rows[:most] for q, rows in want.items()}


def test_many_questions_shuffle_no_postings(spark, monkeypatch):
    """More terms than are pushed down, blocks of few questions and runs of few passages: the result by a plain loop."""
    import math
    from collections import Counter

    where = tempfile.mkdtemp(prefix="spark-")
    texts = {i: " ".join(f"w{(i * j * 7 + j * j) % 97}" for j in range(3 + i % 29)) for i in range(300)} | {500: None, 501: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    asked = {q: [f"w{(q * 31 + j * 5) % 110}" for j in range(8)] for q in range(40)}
    for name, value in (("BLOCK", 50), ("PUSHED_TERMS", 3), ("QUESTIONS", 7)):
        monkeypatch.setattr(index, name, value)
    found = index.Index(f"{where}/index", 4)
    index.add_segment(found, docs)
    words = {i: Counter((x or "").split()) for i, x in texts.items()}
    average, df = sum(c.total() for c in words.values()) / len(words), Counter(w for c in words.values() for w in c)
    want = {}
    for q, terms in asked.items():
        of = {}
        for i, c in words.items():
            parts = [max(math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / average)) for w in set(terms) if c[w]]
            if parts:
                of[i] = sum(parts)
        want[q] = sorted(of.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    best = index.search(found, spark.createDataFrame(list(asked.items()), "question long, terms array<string>").repartition(2), 10)
    got = {}
    for r in sorted(best.collect(), key=lambda r: r["pos"]):
        got.setdefault(r["question"], []).append((r["key"], r["score"]))
    assert {q: [k for k, _ in x] for q, x in got.items()} == {q: [k for k, _ in x] for q, x in want.items()}
    assert all(abs(a - b) < 1e-8 for q in got for (_, a), (_, b) in zip(got[q], want[q], strict=True))
    plan = best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Generate" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_neighbours_carry_few_sets(spark):
    """Many sets of links: the neighbours are those of all pairs, and sets go on by the id of their first meeting."""
    from parlance.operators import retrieval

    links = [(m, kind, f"{kind}{(m * k + m // 5) % n}") for m in range(200) for kind, k, n in (("channel", 7, 6), ("folder", 3, 4), ("channel", 5, 6)) if m % 9]
    links = sorted(set(links))
    seeds, seen = [(q, (q * 37 + i * 11) % 200) for q in range(12) for i in range(3)], {m for m in range(200) if m % 4}
    frames = spark.createDataFrame(links, "meeting long, kind string, key string"), spark.createDataFrame(seeds, "question long, meeting long"), spark.createDataFrame([(m,) for m in seen], "meeting long")
    want = []
    for q in range(12):
        mine = [m for x, m in seeds if x == q]
        shared = {m: sum((s, *x[1:]) in set(links) for s in mine for x in links if x[0] == m) for m in seen - set(mine)}
        want += [(q, m, i + 1) for i, m in enumerate(sorted((m for m in shared if shared[m]), key=lambda m: (-shared[m], m))[:4])]
    found = retrieval.neighbours(*frames, 4, 3)
    assert sorted((r["question"], r["meeting"], r["nth"]) for r in found.collect()) == want
    assert "xxhash64" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_runs_bound_what_is_held_at_once(spark):
    """A term that all passages have is in runs of a bounded size, of an update too, and nothing is sorted by term."""
    found = index.Index(f"{tempfile.mkdtemp(prefix='spark-')}/index", 4)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word"), "id").alias("text")).coalesce(1)
    index.add_segment(found, docs, passages_of_shard=20)
    index.add_segment(found, docs.filter("doc_id < 90"), docs.filter("doc_id < 100"), passages_of_shard=20)
    for _, name in index.segments(spark, found):
        rows = spark.read.parquet(f"{found.path}/segments/{name}/postings")
        assert rows.agg(F.max("n")).first()[0] == 20 and rows.filter("term = 'the'").count() == rows.select("run").distinct().count() >= 5
    asked = spark.createDataFrame([(1, ["the"])], "question long, terms array<string>")
    assert {r["key"] for r in index.scores(found, asked).collect()} == set(range(500)) - set(range(90, 100))
    assert {r["term"]: r["df"] for r in index.document_frequency(spark, found).collect()}["the"] == 490
