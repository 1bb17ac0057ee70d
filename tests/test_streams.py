"""Segments and decoders."""

import os
import tempfile
import zlib

from pyspark.sql import functions as F

from parlance.operators import live
from parlance.sources import rosters, wire
from parlance.streaming import sessions


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_pauses_depend_on_what_was_said(spark):
    frames = [(1, t, 100, 0.5) for t in range(0, 1000, 100)] + [(1, 3000, 100, 0.5)]  # a pause of 2 s in a short segment
    frames += [(2, t, 100, 0.5) for t in range(0, 3500, 100)] + [(2, 4300, 800, 0.5)]  # 800 ms after enough
    frames += [(3, t, 1000, 0.5) for t in range(0, 45000, 1000)] + [(4, 0, 300, 0.5), (5, 0, 2000, 0.0001), (None, 1, 1, 1.0), (6, None, 1, 1.0)]
    got = rows_of(sessions.batch_segments(spark.createDataFrame(frames, "key long, at_ms long, ms long, energy double")))
    assert [(k, a, b) for k, _, a, b, *_ in got] == [(1, 0, 3100), (2, 0, 3500), (2, 4300, 5100), (3, 0, 20000), (3, 20000, 40000), (3, 40000, 45000)]


def test_stream_is_the_batch(spark, sf_dir):
    """What a stream has given, and what is still open, are the batch's segments."""
    frames = sessions.frames_of(spark.read.parquet(f"{sf_dir}/events.parquet"))
    where = tempfile.mkdtemp(prefix="spark-")
    edges = [r["m"] for r in frames.select(F.percentile("at_ms", F.array(F.lit(0.33), F.lit(0.66))).alias("e")).select(F.explode("e").alias("m")).collect()]
    for i, (low, high) in enumerate(zip([0, *edges], [*edges, 1e18], strict=True)):
        frames.filter((F.col("at_ms") >= low) & (F.col("at_ms") < high)).coalesce(1).write.parquet(os.path.join(where, f"in/{i}"))
    # Else batches without data go on until the idle time has passed.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(where, "in/*"))
    query = sessions.stream_segments(source).writeStream.outputMode("append").format("memory").queryName("segments").option("checkpointLocation", os.path.join(where, "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    batch = rows_of(sessions.batch_segments(frames))
    streamed = rows_of(spark.table("segments").filter("is_final"))
    assert streamed and set(streamed) <= set(batch)
    last = {}
    for r in batch:
        last[r[0]] = max(last.get(r[0], -1), r[1])
    assert {r for r in set(batch) - set(streamed) if r[1] != last[r[0]]} == set()


def test_frames(spark):
    named, bare, empty = wire.bytes_of(7, 1718000000456.0, "Alice", [0.5, -0.25]), wire.bytes_of(3, 1.5, None, [1.0]), wire.bytes_of(999, 2.0, None, [])
    broken = [b"short", named[:15], named[:14] + b"\xff\x7f", None]
    data = [(i, p) for i, p in enumerate([named, b"REC1" + named, bare + b"xy", empty, *broken])]
    got = {r["i"]: r["f"] for r in spark.createDataFrame(data, "i int, p binary").select("i", wire.decode_frame("p").alias("f")).collect()}
    assert (got[0]["track"], got[0]["ts_ms"], got[0]["name"], got[0]["samples"]) == (7, 1718000000456.0, "Alice", [0.5, -0.25])
    assert got[1] == got[0] and (got[2]["track"], got[2]["name"], got[2]["samples"]) == (3, None, [1.0]) and got[3]["samples"] == []
    assert all(got[i]["track"] is None for i in range(4, 8))


def test_payloads(spark):
    raw = zlib.compressobj(wbits=-15)
    packed = raw.compress(b"hello") + raw.flush()
    rows = spark.createDataFrame([(packed,), (b"\xff\xff",), (None,)], "p binary").select(wire.inflated("p").alias("x")).collect()
    assert [r["x"] and bytes(r["x"]) for r in rows] == [b"hello", None, None]
    events = spark.createDataFrame([('{"kind": "a", "ts": 1}',), ('{"kind": "a"}',), ("{",)], "t string").select(wire.event_of(F.col("t")).alias("e")).collect()
    assert events[0]["e"]["kind"] == "a" and events[1]["e"] is None and events[2]["e"] is None


def fold_of(frames, **options):
    fold = sessions.Segmenter(sessions.Pauses(**{"short": 700, "enough": 3000, "long": 2500, "most": 5000, "least": 350} | options))
    return [s for f in frames for s in fold.add(*f)] + list(fold.close())


def voice(start, ms, energy=0.2):
    return [(t, 20, energy) for t in range(start, start + ms, 20)]


def test_a_cut_is_at_the_quietest_frame_and_overlaps():
    frames = voice(0, 4800) + voice(4800, 20, 0.01) + voice(4820, 2180)
    finals = [s for s in fold_of(frames) if s[-1]]
    # The quiet frame ends at 4820; what follows begins 600 ms before it.
    assert [(n, a, b, o) for n, a, b, _, _, o, _ in finals] == [(0, 0, 4820, False), (1, 4220, 7000, True)]


def test_previews_share_the_number_of_their_final():
    got = fold_of(voice(0, 4000), most=20000, preview=500)
    assert {s[0] for s in got} == {0} and [s[-1] for s in got] == [False, False, False, True]


def test_pauses_are_kept_up_to_a_second():
    (only,) = [s for s in fold_of(voice(0, 400) + voice(2000, 400)) if s[-1]]
    assert only[1:4] == (0, 2400, 41)  # 20 frames, a silent one, 20 frames
    assert fold_of(voice(0, 300)) == [] and fold_of(voice(0, 2000, 0.0001)) == []


def test_speakers_do_not_mix_and_leave(spark):
    rows = [(k, *f) for k in range(64) for f in voice(k * 10, 600)] + [(3, 5000, 0, None)] + [(3, *f) for f in voice(5000, 600)]
    frames = spark.createDataFrame(rows, "key long, at_ms long, ms long, energy double")
    got = rows_of(sessions.batch_segments(frames, sessions.Pauses(least=350)).select("key", "start_ms", "end_ms"))
    assert got == sorted([(k, k * 10, k * 10 + 600) for k in range(64)] + [(3, 5000, 5600)])


def test_protobuf_fields_by_hand():
    message = bytes.fromhex("0a02c3b1" "20ac02" "e503ffffffff" "090102030405060708")
    assert list(rosters.fields(message)) == [(1, 2, "ñ".encode()), (4, 0, 300), (60, 5, b"\xff" * 4), (1, 1, bytes(range(1, 9)))]
    assert list(rosters.fields(bytes.fromhex("0a0561"))) == [(1, 2, b"a")]  # cut off
    assert list(rosters.fields(bytes.fromhex("20ffffffffffffffffff01" "2001"))) == [(4, 0, (1 << 35) - 1), (4, 0, 1)]
    assert list(rosters.fields(bytes.fromhex("00" "2001"))) == [] and list(rosters.fields(b"")) == []


def test_rosters_by_hand(spark):
    user = bytes.fromhex("0a0164" "120141" "3a0131" "2003" "900201")
    assert rosters.user_of(user) == {"device_id": "d", "full_name": "A", "display_name": "", "picture": None, "status": 3, "parent_device_id": None, "is_current": True, "is_host": True}
    assert rosters.user_of(bytes.fromhex("120141")) is None
    body = bytes.fromhex("6a12" "0a10" "120e") + user[:14]
    whole = bytes([0x0A, len(body) + 2, 0x12, len(body)]) + body
    rows = spark.createDataFrame([(1, whole), (2, b""), (3, b"\x0b"), (4, None)], "i int, p binary").select("i", rosters.roster("p").alias("r")).orderBy("i").collect()
    assert [u["device_id"] for u in rows[0]["r"]["users"]] == ["d"] and rows[0]["r"]["outputs"] == []
    assert rows[1]["r"]["users"] == [] and rows[2]["r"]["users"] is None and rows[3]["r"]["users"] is None
    texts = spark.createDataFrame([("!",), (None,), ("",)], "t string").select(rosters.first_roster(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in texts] == [None, None, []]


def test_numbers_as_bytes(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, (1 << 28) - 1, 1 << 28, (1 << 35) - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", rosters.protobuf_fields(rosters.field_bytes(9, F.col("n"), True)).alias("f")).collect()
    assert all([(f["number"], f["value"]) for f in r["f"]] == [(9, r["n"])] for r in rows)


def test_sound_is_found_behind_other_chunks(spark):
    data = b"RIFF....WAVE" + b"LIST" + bytes.fromhex("0100000061" "00") + b"data" + bytes.fromhex("08000000" "0000803f" "00000040")
    rows = spark.createDataFrame([(1, data), (2, data[:20]), (3, None), (4, data[:-1])], "i int, p binary").orderBy("i").select(rosters.wav_samples("p").alias("s")).collect()
    assert [r["s"] for r in rows] == [[1.0, 2.0], None, None, [1.0]]


def test_three_votes_rebind_and_many_held_rows_get_a_track(spark):
    votes = [(1, i, p) for i, p in enumerate(["a", None, "a", "b", "a", "a", "a", "b", None, "b", "a", "b", "b", "b"])]
    votes += [(2, i, "ab"[i % 2]) for i in range(17)] + [(3, 0, "a"), (None, 1, "a")]
    got = live.rebound(spark.createDataFrame(votes, "c long, i long, p string"), "c", "i", "p", ["i"])
    of = {(r["c"], r["i"]): (r["held"], r["owner"]) for r in got.collect()}
    held = {0, 1, 2, 3, 4, 5, 7, 9, 11, 12}
    assert {i: v for (c, i), v in of.items() if c == 1} == {i: (i in held, "a" if i < 7 or i in (8, 10) else "b") for i in range(14)}
    assert {v for (c, i), v in of.items() if c == 2 and i < 16} == {(True, "track:2")} and of[2, 16] == (True, None)
    assert of[3, 0] == (True, None) and len(of) == 32
