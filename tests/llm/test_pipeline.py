"""The stages of the corpus pipeline: near copies by brute force, odd rows and empty tables in every stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ngram_join import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:59], "end"]), " ".join(f"v{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50)), None, "", "  ", "one two", "call +1 (377) 555-0271 now"]
    made = [(i, t, "en", "a" if i % 2 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*made, made[7], (None, "nobody has this id", "en", "b", 18), (None, None, None, None, None)]


def test_one_of_each_group_stays(spark, rows, sf_dir):
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    sets = {r[0]: shingles(r[1], 5) for r in rows if r[0] is not None}
    gone = {b for b in sets for a in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(sets) - gone) and gone == {1, 3}
    assert sum(r["doc_id"] is None for r in kept) == 2


def test_near_copies_of_documents(spark, documents, sf_dir):
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, documents, sf_dir).collect()}
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in documents.collect()}
    near = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    root = {}
    for b in sorted(sets):
        root[b] = b
        for a in [a for a in sorted(root) if a < b and near(a, b)]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    assert kept == {k for k, v in root.items() if k == v}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_empty_tables(spark, rows, sf_dir, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, sf_dir)
    if name != "bpe":
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if name == "pii":
        texts = {r["doc_id"]: r for r in out.collect()}
        assert out.count() == len(rows) and texts[8]["text"] != rows[8][1] and texts[8]["n_chars"] == len(texts[8]["text"])
    elif name == "toxicity":
        assert out.count() == len(rows)
    elif name == "bpe":
        got = {r["doc_id"]: r for r in out.collect()}
        assert got[4]["n_tokens"] == 0 and got[0]["decoded_sha256"] == hashlib.sha256(rows[0][1].encode()).hexdigest()
    else:
        assert out.filter(F.col("doc_id") == 0).count() > 0


def test_rows_and_not_ids_decide(spark, sf_dir):
    """Clashing names, one id with several texts, copies without an id, ties, and a very long text."""
    long = " ".join(f"long{i % 977} {i}" for i in range(60_000))
    copy = " ".join(f"same{i}" for i in range(40))
    rows = [(1, copy, "a"), (1, "something else altogether is said here by someone", "b"), (None, "no id but words enough to be compared", "c"), (None, "no id but words enough to be compared", "d"), (2, copy, "e"), (None, copy, "f"), (3, long, "g"), (4, long + " end", "h"), (5, None, "i"), (5, None, "j"), (6, "", "k"), (0, "x y", "l"), (7, "x y", "m")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, number string, row string, component_id string"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, tag, "r", "c") for i, t, tag in rows], schema)
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    tags = {r["number"] for r in kept.collect()}
    assert len(tags & {"c", "d"}) == 1 and tags - {"c", "d"} == set("abgijkl")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_clashing_columns_stay(spark, sf_dir, name):
    columns = "number string, row string, size long, score double, at long, threshold long, label int, key string"
    docs = spark.createDataFrame([(i, "w " * i + f"unlike {i} other", "en", "ab"[i % 2], 9, "n", "r", i, 0.5, 1, 2, 3, "k") for i in range(1, 30)], f"{SCHEMA}, {columns}")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert out.columns == docs.columns and {(r["number"], r["key"], r["threshold"]) for r in out.collect()} == {("n", "k", 2)}


def test_three_copies_at_most(spark, sf_dir):
    rows = [(i, "", "en", "a", 0) for i in range(40)] + [(100, "one word", "en", "a", 8)] + [(200 + i, "many words are here " * 30, "en", "b", 1) for i in range(40)]
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) == 3


def test_what_a_stage_wrote_is_freed(spark, sf_dir, monkeypatch):
    from parlance.llm import common

    paths, counts = [], []
    held = lambda: [spark.read.schema("doc_id long").parquet(p).count() for p in paths]

    def stage(spark, docs, sf_dir):
        counts.append(held())
        paths.append(common.written(docs.limit(5), "mine").inputFiles()[0].rpartition("/")[0])
        return docs.filter("doc_id % 3 > 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("last", lambda spark, docs, sf_dir: docs)])
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and counts == [[], [0]] and held() == [0, 0]
