import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import toxicity
from parlance.llm.common import held_out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


TERMS = ["idiot", "scum", "worthless", "disgusting", "abend", "achlich*", "dumm*"]


def nearest(word):
    """The best (distance, term) by comparing with every term."""
    found = []
    for n, term in enumerate(TERMS):
        if term.endswith("*"):
            # A stem is held against each beginning of the word.
            if (d := min(distance(word[:i], term[:-1]) for i in range(len(word) + 1))) <= toxicity.Automaton.edits(term):
                found.append((d, n))
        elif (d := distance(word, term)) <= toxicity.Automaton.edits(term):
            found.append((d, n))
    return min(found)[0] if found else None


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["", "x", "i", "dd"])), max_size=3))
def test_automaton(term, edits):
    word = term.rstrip("*")
    for at, put in edits:
        word = word[:at] + put + word[at + 1 :]
    code = int(toxicity.Automaton(TERMS).match([word])[0]) if word else 0
    assert (None if code == 0 else (code - 1) % 4) == (nearest(word) if word else None)


def test_automaton_over_short_words():
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("scumx", repeat=n)][:3000]
    codes = toxicity.Automaton(TERMS).match(words)
    assert [(None if c == 0 else (c - 1) % 4) for c in codes.tolist()] == [nearest(w) for w in words]


def test_quotation_counts_less():
    reader = toxicity.Reader(toxicity.Lexicon.of(["idiot"], np.array([5.0])))
    plain, quoted, said = reader.features(["you are an idiot and a fool", 'they wrote "an idiot" in the paper', "the word idiot is old"])
    window = toxicity.FEATURES.index("window")
    assert plain[window] > quoted[window] and plain[window] > said[window] and quoted[toxicity.FEATURES.index("quoted")] > 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(clean) < 0.02


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1, int(i in (5, 6))) for i in range(1, 9)] + [(None, 1, 1), (4, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == odd.count()
    model = toxicity.fit(odd, labels.limit(0))
    assert toxicity.keep(odd, model).count() == odd.count()


@pytest.mark.parametrize("doc_id", [0, 5, 17, 123456])
def test_held_out_is_by_crc32(spark, doc_id):
    import zlib

    assert spark.range(doc_id, doc_id + 1).select(held_out("id").alias("h")).first()["h"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


@pytest.mark.parametrize(("sf", "least"), [("0.001", {"en": 7}), ("0.01", {"en": 34, "de": 5, "es": 4, "fr": 3})])
def test_terms_of_few_rows(spark, sf, least):
    """Small tables and languages with few toxic rows have terms too."""
    d = f"/root/testdata/sf{sf}"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = docs.join(labels.filter("toxic = 1"), "doc_id").select("text", "lang").collect()
    hit = model.reader().features([r["text"] for r in rows])[:, :3].any(1)
    for lang, n in least.items():
        assert sum(h for h, r in zip(hit.tolist(), rows, strict=True) if r["lang"] == lang) >= n


def test_terms_of_a_stratum(spark):
    """A term in 5 of 4000 toxic rows is below the support over all rows, but not in its own script."""
    rows = [(f"the {'scum' if i % 2 else 'table'} is here w{i}", i % 2) for i in range(8000)]
    rows += [(f"это {'гад' if i < 5 else 'стол'} и дом с{i}", int(i < 5)) for i in range(60)]
    terms, weights = toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert {"scum", "гад"} <= set(terms) and min(weights) > 0


def test_chance():
    assert toxicity.chance(3, 0, 10, 90) == pytest.approx(0.001) and toxicity.chance(3, 0, 1, 1) == pytest.approx(0.125)
    assert toxicity.chance(0, 5, 1, 9) == pytest.approx(1.0)


def test_quotations_of_any_length():
    long = " ".join(["word"] * 100)
    inside = lambda text: [text[a + 1 : b] for a, b in toxicity.quotations(text)]
    assert inside(f'he said "{long} idiot {long}" and left') == [f"{long} idiot {long}"]
    assert inside(f'"so" then {long} idiot {long} and "end"') == ["so", "end"]
    assert inside("„ja“ und «oui» und »nein« don’t ‘no don’t’ \"open\n idiot \"x\"") == ["ja", "oui", "nein", "no don’t", "x"]
    assert inside("“one “two” three") == ["two"] and inside("") == []


def test_misspelled_stems():
    automaton = toxicity.Automaton(["blockhe*", "idiot", "ab*"])
    found = automaton.match(["blockheads", "blokheads", "blockkheads", "blocheads", "idiott", "abc", "acb", "bloheads"])
    names = [(["blockhe*", "idiot", "ab*"][(f - 1) // 4], int(f - 1) % 4) if f else None for f in found.tolist()]
    assert names == [("blockhe*", 0), ("blockhe*", 1), ("blockhe*", 1), ("blockhe*", 1), ("idiot", 1), ("ab*", 0), None, None]


def test_rows_are_bounded_where_an_id_repeats(spark):
    docs = spark.createDataFrame([(1, f"you idiot {i}") for i in range(300)] + [(i, f"fine text number {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), *[(i, 0) for i in range(2, 60)]], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample_rows=20)
    assert model.scores(model.reader().features(["you idiot 5", "fine text"])).shape == (2,)


def test_long_words_and_terms():
    term = "x" * 70
    automaton = toxicity.Automaton([term, "wordword*", "y" * 60])
    words = [term, term + "x", "wordword" + "z" * 200, "wordxword" + "z" * 100, "y" * 62, "y" * 63, "y" * 58, "", "é"]
    assert automaton.match(words).tolist() == [1, 0, 5, 6, 11, 0, 11, 0, 0] and automaton.match([]).tolist() == []


def edited(text, terms, how):
    """Each word that a term matches, with one letter changed in its middle."""
    words, stems = {t for t in terms if not t.endswith("*")}, tuple(t[:-1] for t in terms if t.endswith("*"))

    def change(m):
        w, k = m.group(), len(m.group()) // 2
        if w.lower() in words or w.lower().startswith(stems):
            return {"doubled": w[:k] + w[k] * 2 + w[k + 1 :], "dropped": w[:k] + w[k + 1 :], "replaced": w[:k] + "q" + w[k + 1 :]}[how]
        return w

    return toxicity.WORDS.sub(change, text)


def test_misspelled_texts_are_caught(spark):
    """Held-out toxic texts with one edit in every term are still caught, and clean and quoting ones left alone."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = docs.join(labels, "doc_id").filter(held_out()).select("text", "toxic").collect()
    bad, good = ([r["text"] for r in rows if r["toxic"] == t] for t in (1, 0))
    caught = lambda texts: (model.scores(model.reader().features(texts)) >= 0.5).mean()
    assert caught(bad) > 0.85 and caught(good) < 0.02
    # Where a letter is dropped or replaced some words come near usual ones, or within no edit of a short term.
    for how, least in (("doubled", 0.8), ("replaced", 0.7), ("dropped", 0.65)):
        assert caught([edited(t, model.terms, how) for t in bad]) > least
    quoting = [" ".join(good[i % len(good)].split()[:60] + ["“" + w + "”" for w in ("idiot", "moron")] + good[i % len(good)].split()[60:200]) for i in range(40)]
    # Four of the forty are flagged; the bound is what was measured.
    assert caught(quoting) <= 0.1
    # No hit lowers a score.
    assert (model.coefficients[:5] >= 0).all() and model.coefficients[toxicity.FEATURES.index("quoted")] <= 0
    assert (model.lexicon.misspelled <= model.lexicon.weights + 1e-12).all() and (model.lexicon.misspelled >= 0).all()


def test_usual_words_are_no_misspellings():
    lexicon = toxicity.Lexicon.of(["idiot", "moro*"], np.array([3.0, 3.0]))
    lexicon.usual = {"idiom": 0, "moroso": 5}
    reader = toxicity.Reader(lexicon)
    whole, stems, fuzzy = reader.features(["an idiom", "an idiox", "moroso", "idiot"])[:, :3].T
    assert (whole > 0).tolist() == [False, False, False, True] and (stems > 0).tolist() == [False, False, True, False] and (fuzzy > 0).tolist() == [False, True, False, False]


def test_bounded_regression():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 7))
    y = (x[:, 0] - x[:, 2] + x[:, 5] + rng.normal(size=400) > 0).astype(float)
    theta = toxicity.regression(np.c_[x, np.ones(400)], y, np.ones(400), np.full(8, 0.1))
    assert (theta >= toxicity.LEAST).all() and (theta <= toxicity.GREATEST).all() and theta[0] > 0.5 and theta[2] == 0 and theta[5] == 0
    # At a free coefficient the gradient is zero, at a bound it points beyond.
    p = 1 / (1 + np.exp(-(np.c_[x, np.ones(400)] @ theta)))
    gradient = np.c_[x, np.ones(400)].T @ (p - y) + 0.1 * theta
    assert abs(gradient[[0, 6, 7]]).max() < 1e-3 and gradient[2] > 0 and gradient[5] < 0
