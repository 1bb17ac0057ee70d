"""Language, tokens, quality rules: brute force and odd rows."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from parlance.llm import bpe, fertility, language

VOCABULARY, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_gradients():
    rng = np.random.default_rng(1)
    net = language.start(["a", "b", "c"], 3)
    for n in ("tables", "loops", "outs"):
        setattr(net, n, [p.astype(np.float64) for p in getattr(net, n)])
    net.bias = net.bias.astype(np.float64)
    x, y = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    _, grads = language.gradients(net, x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = (x[3, 2], 1) if p.shape[0] == 256 else tuple(rng.integers(0, s) for s in p.shape)
        was = p[at]
        p[at] = was + 1e-4
        up, _ = language.gradients(net, x, y)
        p[at] = was - 1e-4
        down, _ = language.gradients(net, x, y)
        p[at] = was
        assert abs(g[at] - (up - down) / 2e-4) < 1e-6


def test_labels_each_position():
    """Windows side by side give what one position after another gives."""
    net = language.start(["a", "b"], 5)
    texts = ["abc", "x" * 300, "", "é"]
    got = language.probabilities(net, pa.array(texts))
    for text, p in zip(texts, got, strict=True):
        total, raw = np.zeros(2), text.encode()
        for i in range(0, len(raw), language.WINDOW):
            part = np.frombuffer(raw[i : i + language.WINDOW], np.uint8)[:, None]
            f = [t[-1] for t in language._run(net.tables[0], net.loops[0], part)]
            b = [t[-1] for t in language._run(net.tables[1], net.loops[1], part[::-1])][::-1]
            for x, y in zip(f, b, strict=True):
                total += language._softmax(x @ net.outs[0] + y @ net.outs[1] + net.bias)[0]
        assert np.allclose(p, total / max(1, len(raw)), atol=1e-5)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_of_odd_rows(odd, empty):
    rows = language.language_id(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4
    assert {r["lang_pred"] for r in rows} <= {"de", "en", "ja", "und"}
    assert language.language_id(empty).count() == 0


def test_bpe_is_the_library(spark, odd, documents):
    library = Tokenizer.from_file(VOCABULARY)
    for docs in (odd, documents):
        texts = collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
        want = collections.Counter()
        for (i, t), n in texts.items():
            ids = library.encode(t, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += n
        got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest(docs, VOCABULARY).collect())
        assert got == want


def test_bpe_of_hard_texts(empty):
    library, encoder = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.load(VOCABULARY))
    rng = np.random.default_rng(3)
    texts = ["a" * 5000, "ab" * 999, "  x\n\n y \t", "<|endoftext|>" * 3, " <|endoftext|> ", "it's I'LL 's", "\u00a0x \u2003y", *("".join(rng.choice(list("abe éß世 \n1'!"), 200)) for _ in range(200))]
    ids, offsets = encoder.encode(texts)
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids
    assert bpe.digest(empty, VOCABULARY).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), len(words) < 50 or 2 * len(covered) > len(words)


def test_quality_counts(odd, documents, empty):
    for docs in (odd, documents):
        want = collections.Counter((r["doc_id"], *counts(r["text"])) for r in docs.collect())
        rows = fertility.rules(docs, MODEL).collect()
        assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
        assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert fertility.rules(empty, MODEL).count() == 0


def test_fertility_by_the_library(documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] for r in documents.limit(30).collect()}
    for r in fertility.measure(documents.limit(30), MODEL).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        ids = [i for x in model.encode(words, num_threads=1) for i in x]
        share = np.array(list(collections.Counter(ids).values())) / len(ids)
        assert r["n_tokens"] == len(ids)
        assert abs(r["entropy"] + (share * np.log2(share)).sum()) < 1e-9
        assert abs(r["byte_share"] - np.mean([model.is_byte(i) for i in ids])) < 1e-12


def test_bands(spark):
    words = " ".join(f"{a}{b}" for a in ("the", "reason", "winter", "garden", "music", "letter", "people") for b in ("s", "ing", "", "ed", "al", "er", "ful", "less"))
    noise = " ".join("qzxjkvwqzxjkvw" for _ in range(60))
    rows = spark.createDataFrame([(1, words), (2, "\u2581\U0001f9ff\u16a0 " * 60), (3, noise)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in fertility.rules(rows, MODEL).collect()} == {1: True, 2: False, 3: False}


def test_what_is_a_letter(spark):
    from parlance.llm import language

    marks = ["²", "½ ①", "Ⅷ", "12 _", "\u0301", "", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*marks, "some words here", "more words there", "x"])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.language_id(docs).collect()}
    assert all(got[i] == "und" for i in range(len(marks))) and all(got[i] == "en" for i in range(len(marks), len(marks) + 3))
