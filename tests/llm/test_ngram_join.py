import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import ngram_join
from parlance.llm.components import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, percent):
    """All pairs, compared."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(repr((d, len(s), least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def result(docs, **options):
    return sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in ngram_join.ngram_join(docs, **options).collect())


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(odd) == brute(rows, 4, 85)
    assert ngram_join.ngram_join(empty).count() == 0


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 256), (5, 80, 256), (2, 60, 8)])
def test_against_all_pairs(spark, monkeypatch, k, percent, block):
    """Families of near copies, chains, shared passages, and passages that make most of a text."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PAIRS_A_BUCKET", 2000)
    monkeypatch.setattr(ngram_join, "HELD", 1000)
    rng = np.random.default_rng(k)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 3))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(int(rng.integers(3, 160)))]
        for _ in range(int(rng.integers(1, 9))):
            base = list(base)
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(0, len(base)))] = word()
            texts.append(base)
    for n in rng.integers(1, 40, 90):
        own = [word() for _ in range(n)]
        texts.append([*own[: n // 2], *passage, *own[n // 2 :]])
    texts += [passage[:i] for i in range(1, 60, 3)]
    rows = [(i * 3 % 1009, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(docs, k=k, percent=percent) == brute(rows, k, percent)


def test_many_copies_in_a_piece(spark):
    """Over FREQUENT texts in one piece share all but a word."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:40], f"x{i}", *base[40:]])) for i in range(150)] + [(1000, " ".join(base[:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert result(docs) == brute(rows, 4, 85)


def test_prefix_filter_loses_nothing():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.choice(1 << 40, int(rng.integers(1, 60)), replace=False).astype(np.uint64)
        b = np.unique(np.r_[rng.permutation(a)[: int(rng.integers(0, len(a) + 1))], rng.choice(1 << 40, int(rng.integers(0, 12))).astype(np.uint64)])
        a = np.sort(a)
        if len(b) and ngram_join.similar(a, b, 85):
            for values, ends in ngram_join.order_prefixes(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), 85):
                assert set(values[: ends[1]]) & set(values[ends[1] :])


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 9), (9, 8), (7, 7), (8, 10), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 7), 1), 8: 8, 9: 8, 10: 8, 7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_are_exact(documents):
    want = {r["doc_id"]: len(shingles(r["text"], 4)) for r in documents.collect()}
    got = {r["doc_id"]: r["n"] for r in ngram_join.profiles(documents, 4, "doc_id", "text").collect()}
    assert got == want


def test_other_names(spark):
    docs = spark.createDataFrame([("x", "a b c d e"), ("y", "a b c d e")], "name string, body string").withColumn("text", F.lit(1))
    got = ngram_join.ngram_join(docs, doc_id="name", text="body").collect()
    assert {r["component_id"] for r in got} == {"x"}


def test_documents_against_all_pairs(documents):
    """Every row whose id is divisible by 50 against all rows: no link between different texts is lost."""
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    sets = {d: shingles(t, 4) for d, t in rows}
    component = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(documents).collect()}
    linked = [(q, d) for q in sets if q % 50 == 0 for d in sets if sets[q] and sets[d] and 100 * len(sets[q] & sets[d]) >= 85 * len(sets[q] | sets[d])]
    assert all(component[q] == component[d] for q, d in linked)
    assert result(documents) == brute(rows, 4, 85)


def test_keys_of_one_half_may_meet(spark, monkeypatch):
    """Where the first halves of keys collide the second tells sets apart."""
    whole = ngram_join.set_keys
    monkeypatch.setattr(ngram_join, "set_keys", lambda v, o, half=0: whole(v, o, half) if half else np.where(np.diff(o) > 0, 1 + whole(v, o) % 3, 0))
    words = [[f"w{i}x{j}" for j in range(30)] for i in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(50 + i, " ".join([*w[:-1], "end"])) for i, w in enumerate(words)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 4, 85)
