"""Functions and folds against values worked out by hand."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as t
from parlance.functions import values as v
from parlance.operators import folds, joins, ranking


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("question", "expected"),
    [("¿Qué decidimos sobre el despliegue de Kafka?", '"decidimos" OR "despliegue" OR "kafka"'), ("kafka kafka KAFKA despliegue", '"kafka" OR "despliegue"'), ("¿y eso?", None), ("   ", None), ("what was that", None)],
)
def test_query_terms(spark, question, expected):
    assert one(spark, t.or_query(F.lit(question))) == expected


@pytest.mark.parametrize(("ms", "expected"), [(0, "00:00"), (62_000, "01:02"), (3_723_000, "01:02:03")])
def test_timestamp(spark, ms, expected):
    assert one(spark, t.timestamp(F.lit(ms))) == expected
    assert one(spark, t.parse_timestamp(F.lit(f"[{expected}]"))) == ms


def test_parse_timestamp_of_no_time(spark):
    assert one(spark, t.parse_timestamp(F.lit("soon"))) is None
    assert one(spark, t.parse_timestamp(F.lit("1:2:3:4"))) is None


def test_equalities_stay_apart(spark):
    name = F.lit(" Ángela  Pérez-Ruiz ")
    assert one(spark, t.folded(name)) == "angela perez ruiz"
    assert one(spark, t.person_key(name)) == "angela  perez-ruiz"
    assert one(spark, t.ascii_key(F.lit("ÁNGELA"))) == "Ángela"
    assert one(spark, t.folded(F.lit("São"))) == "são"
    assert one(spark, t.person_key(F.lit("São"))) == "sao"


def test_excerpt(spark):
    x = one(spark, t.excerpt(F.lit("Hola, ¿cómo estás? Aquí hablamos de Kafka."), F.array(F.lit("como"))))
    assert (x["before"], x["matched"], x["after"]) == ("Hola, ¿", "cómo", " estás? Aquí hablamos de Kafka.")
    assert one(spark, t.excerpt(F.lit("nada"), F.array(F.lit("como")))) is None


def test_texts(spark):
    assert one(spark, t.clamped_title(F.lit("word " * 30))) == ("word " * 11).strip() + "…"
    assert one(spark, t.truncated(F.lit("abcdef"), 3)) == "abc…"
    assert one(spark, t.truncated(F.lit("abcdef"), 3, whole=False)) == "ab…"
    assert one(spark, t.slug(F.lit("Mi Servidor: Sala 1"))) == "mi-servidor-sala-1"
    assert one(spark, t.markdown_escaped(F.lit("a*b_c"))) == r"a\*b\_c"
    assert one(spark, t.interpolated(F.lit("{a} {b}"), F.create_map(F.lit("a"), F.lit("x")))) == "x {b}"
    assert one(spark, t.usable_name(F.lit("12345"), F.lit(" 12345 "))) is None and one(spark, t.usable_name(F.lit("spaces/x/devices/7"))) is None
    assert one(spark, t.usable_name(F.lit("  Ana   B "))) == "Ana B"
    assert one(spark, t.query_parameter(F.lit("http://x/?a=1+2&b=%zz"), "a")) == "1 2"


def test_values(spark):
    day = F.lit(dt.date(2026, 8, 6))
    assert one(spark, v.spanish_date(day)) == "6 agosto 2026"
    assert one(spark, v.day_bucket(day, dt.date(2026, 8, 7))) == "yesterday"
    assert one(spark, v.day_bucket(day, dt.date(2027, 8, 7))) == "month:2026-7"
    grid = one(spark, v.month_grid(F.lit(dt.date(2026, 8, 1))))
    assert len(grid) == 42 and grid[0] == dt.date(2026, 7, 27) and grid[0].weekday() == 0
    assert one(spark, v.sanitized_tags(F.array(*[F.lit(x) for x in ("Ventas", " ventas ", "", "a  b")]))) == ["Ventas", "a b"]
    assert len(one(spark, v.sanitized_tags(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda x: x.cast("string"))))) == 12
    assert one(spark, v.downmixed(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))))) == [0.5, 0.5]
    assert one(spark, v.resampled(F.array(*[F.lit(float(x)) for x in range(6)]), 48000, 16000)) == [0.0, 3.0]
    assert one(spark, v.peak(F.array(F.lit(-0.5), F.lit(0.25)))) == 0.5
    assert one(spark, v.first_field(F.lit('{"b": "", "a": "x"}'), ["b", "a"])) == ""


@pytest.mark.parametrize("text", ["", "a", "foobar", "Ángela"])
def test_fnv1a(spark, text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert one(spark, v.fnv1a(F.lit(text))) == f"{h:016x}"


def items(*texts):
    return F.array(*[F.struct(F.lit(x).alias("text")) for x in texts])


def test_windows_overlap_by_one(spark):
    windows = one(spark, folds.size_windows(items("a" * 500, "b" * 300, "c" * 200, "d" * 10)))
    assert [[x["text"][0] for x in w] for w in windows] == [["a", "b"], ["b", "c", "d"]]
    # A window of one item carries nothing, and an item longer than the limit is a window.
    assert [[x["text"][0] for x in w] for w in one(spark, folds.size_windows(items("a" * 2700, "b", "c")))] == [["a"], ["b", "c"]]
    assert one(spark, folds.size_windows(F.array().cast("array<struct<text:string>>"))) == []


def test_pages(spark):
    assert one(spark, folds.pages(F.array(F.lit("aa"), F.lit("bb"), F.lit("c")), most=5)) == ["aa\nbb", "c"]


def test_merged_turns(spark):
    rows = spark.createDataFrame([(1, 0, "Ana", 0, 1000, "hola"), (1, 1, "Ana", 1000, 2000, "vamos"), (1, 2, "Luis", 1500, 1600, "  "), (1, 3, "Ana", 2000, 2100, "ya"), (1, 4, "Luis", 62000, 63000, "de acuerdo")], "meeting_id int, seq int, speaker string, start_ms int, end_ms int, text string")
    got = [(r["speaker"], r["end_ms"], r["text"]) for r in folds.merged_turns(rows).orderBy("start_ms").collect()]
    assert got == [("Ana", 2100, "hola vamos ya"), ("Luis", 63000, "de acuerdo")]
    kept = [(r["speaker"], r["text"]) for r in folds.merged_turns(rows, blanks=True).orderBy("start_ms").collect()]
    assert kept == [("Ana", "hola vamos"), ("Ana", "ya"), ("Luis", "de acuerdo")]


def test_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 5), (2, 1, 4), (2, 2, 4), (2, 3, 4), (2, 4, 1)], "k int, n int, cost int")
    got = sorted((r["k"], r["n"]) for r in folds.within_budget(rows, ["k"], ["n"], F.col("cost"), 10).collect())
    assert got == [(1, 1), (2, 1), (2, 2)]


def test_upserts_keep_their_place(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "id string, seq int, text string")
    assert {(r["id"], r["place"], r["text"]) for r in folds.upserts(rows, ["id"], "seq").collect()} == {("a", 1, "z"), ("b", 2, "y")}


def test_bm25_floor(spark):
    docs = spark.createDataFrame([(1, "kafka kafka plan"), (2, "kafka"), (3, None), (4, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in ranking.bm25(docs, ["kafka"]).collect()}
    assert set(got) == {1, 2} and all(0 < s < 1e-4 for s in got.values())
    assert ranking.bm25(docs, []).count() == 0


def test_first_speaker(spark):
    tasks = spark.createDataFrame([(1, "ANA"), (2, "luis.dev"), (3, None), (4, "Ángel")], "task int, assignee string")
    speakers = spark.createDataFrame([(2, "ana", "x"), (1, "Ana", "y"), (3, "Luis", "Luis.Dev"), (4, "ángel", "z")], "speaker_no int, display_name string, username string")
    got = {r["task"]: r["speaker"] for r in joins.first_speaker(tasks, speakers, "assignee", "task").collect()}
    assert got == {1: "Ana", 2: "Luis", 3: None, 4: None}


def test_tags_of_whole_texts(spark, sf_dir, tmp_path):
    """Against the rule in plain Python; some texts repeat words beyond the fortieth."""
    from parlance import registry

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(-1, "same " * 60 + "other Same last"), (-2, " " * 50 + "late\t word"), (-3, None), (-4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def tags(text):
        out = []
        for part in text.split(" "):
            tag = re.sub(r"[ \t\n\x0b\f\r]+", " ", part).strip(" ")[:24].strip(" ")
            if tag and len(out) < 12 and tag.lower() not in (o.lower() for o in out):
                out.append(tag)
        return out

    got = {r["doc_id"]: r["tags"] for r in registry.queries()["scl_a1_tags"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else tags(t) for i, t in rows}
    assert got[-1] == ["same", "other", "last"] and got[-2] == ["late", "word"]


def test_questions_and_titles(spark):
    ask = lambda q: one(spark, t.or_query(F.lit(q)))
    assert ask("¿Qué decidimos sobre el despliegue de Kafka?") == '"decidimos" OR "despliegue" OR "kafka"'
    assert ask("kafka kafka KAFKA despliegue") == '"kafka" OR "despliegue"'
    assert ask("¿y eso?") is None and ask("   ") is None and ask("what was that") is None
    title = lambda *n: one(spark, t.fallback_title(F.array(*map(F.lit, n)).cast("array<string>"), F.lit("Zoom"), F.lit("Sala")))
    assert title() == "Reunión de Zoom" and title("Ana", " ") == "Sesión de Ana" and title("Ana", "Luis", "Eva") == "Ana, Luis y Eva" and title("Ana", "Luis", "Eva", "Sol") == "Ana, Luis y 2 más"
    assert one(spark, t.fallback_title(F.array().cast("array<string>"), F.lit("Mi Servidor"), F.lit("Sala"))) == "Reunión en #Sala"


def test_excerpts(spark):
    said = F.array(F.struct(F.lit("nada").alias("text"), F.lit("Luis · 00:01").alias("source")), F.struct(F.lit("Hola, ¿cómo estás? Aquí hablamos de Kafka.").alias("text"), F.lit("Ángela · 01:02").alias("source")))
    found = one(spark, t.first_match(said, F.array(F.lit("como"))))
    assert tuple(found) == ("Hola, ¿", "cómo", " estás? Aquí hablamos de Kafka.", "Ángela · 01:02")
    assert one(spark, t.first_match(said, F.array(F.lit("postgres")))) is None


def test_broken_escapes_and_templates(spark):
    assert one(spark, t.percent_decoded(F.lit("a%20b+c%zz%4"))) == "a b c%zz%4"
    assert one(spark, t.query_parameter(F.lit("http://x/?a.b=1&axb=2"), "a.b")) == "1"
    values = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("2"))
    assert one(spark, t.interpolated(F.lit("{a} {b} {c}"), values)) == "{b} 2 {c}"
    assert one(spark, t.tokens(F.lit("Ça VÃ Ångström e\u0301"))) == ["ca", "va", "angstrom", "e"]


def test_json_in_answers(spark):
    found = lambda x: one(spark, t.first_json_object(F.lit(x)))
    assert found('Sure: {"a": "}", "b": {"c": "\\\\\\"{"}} {') == '{"a": "}", "b": {"c": "\\\\\\"{"}}'
    assert found("{ open") is None and found("none") is None
    s = one(spark, t.summary_of(F.lit('x {"meeting_title": " T ", "key_points": ["a", " "], "tasks": [{"task": "do", "owner": "null", "time": "[1:02]"}, {"text": ""}]} y')))
    assert (s["title"], s["key_points"], [tuple(x) for x in s["action_items"]]) == ("T", ["a"], [("do", None, None, 62000)])
    assert one(spark, t.summary_of(F.lit('{"title": "only"}'))) is None


def test_an_answer_is_parsed_once(spark):
    from parlance.plans.scalars import scl_j4_summary

    plan = scl_j4_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("regexp_extract_all(") == 1
    raw = ['{"notes": [{"note": " n ", "speaker": "Ana", "time": "3"}]}', '{"overview": " o "}', '{"title": "x", "tasks": [{"task": "null"}]}', "{} {", "", None, '{"decisions": [" ", "d"]} {"overview": "late"}', '{"overview": ']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i long, raw string").select("i", t.summary_of(F.col("raw")).alias("s"))
    got = {r["i"]: r["s"] for r in df.filter("s IS NOT NULL").collect()}
    assert got.keys() == {0, 1, 6} and got[0]["notes"][0].asDict() == {"text": "n", "author": "Ana", "source_ms": 3000}
    assert (got[1]["overview"], got[1]["action_items"], got[6]["decisions"], got[6]["overview"]) == ("o", [], ["d"], "")


def test_signatures(spark):
    import base64
    import hashlib
    import hmac

    want = base64.b64encode(hmac.new(b"k" * 32, b"id.1.body", hashlib.sha256).digest()).decode()
    assert one(spark, v.hmac_sha256(F.lit(b"k" * 32), F.lit(b"id.1.body"))) == want
    ids = [0, 1, 80351110224678912, (0x5745 << 48) + 12345, 2**62]
    want = [((i * 0x9E3779B97F4A7C15) % 2**64 >> 32) % 8 for i in ids]
    assert [r["c"] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(v.palette_index(F.col("id")).alias("c")).collect()] == want


def test_overlap_of_turns(spark):
    cut = lambda a, b: one(spark, t.without_overlap(F.lit(a).cast("string"), F.lit(b)))
    assert cut("vamos con el despliegue", "El despliegue, ahora") == "ahora" and cut("de acuerdo", "acuerdo total") == "total"
    assert cut("y si", "si eso") == "si eso" and cut(None, " hola ") == "hola" and cut("", "hola") == "hola"
