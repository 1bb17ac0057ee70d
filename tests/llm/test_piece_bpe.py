"""SentencePiece encoding and decoding against the library itself."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from parlance.llm import piece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return piece_bpe.load(MODEL)


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_is_the_library(spark, odd, documents, empty, library):
    for docs in (odd, documents):
        want = collections.Counter()
        for r in docs.collect():
            ids = library.encode(r["text"] or "")
            want[(r["doc_id"], len(ids), hexed(",".join(map(str, ids))), hexed(library.decode(ids)))] += 1
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_bpe.digest(docs, MODEL).collect()) == want
    assert piece_bpe.digest(empty, MODEL).count() == 0


def test_hard_texts(library, vocabulary):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyzABC  \u2581\n\t.,!1290éßжи世界日本한국😀\u0301\x00<0xA>")
    texts = ["a" * 5000, "ab" * 999, "  x\n\n y \t", "<s>", " ", " " * 150, "\u2581", "\u2581\u2581 x", "", None, "\x00", "<0x0A>", "世界" * 50, "\u00a0x \u2003y", "\r\n"]
    texts += ["".join(rng.choice(letters, rng.integers(1, 300))) for _ in range(1500)]
    encoder = piece_bpe.Encoder(vocabulary)
    for t, joined in zip(texts, encoder.encode(texts), strict=True):
        assert joined == ",".join(map(str, library.encode(t or "")))
    parts = [t.replace(" ", piece_bpe.SPACE) for t in texts if t]
    assert encoder.walk(parts) == [encoder.walk_one(p) for p in parts]


def test_short_parts_are_merged_together(library, vocabulary, monkeypatch):
    """Many different words take some look-ups of whole arrays, and no test of pairs one by one (before: some for each character)."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abdeéinorstuß"), rng.integers(1, 40))) for _ in range(3000)]
    calls = []
    pair, merges = piece_bpe.Encoder._pair, piece_bpe.Encoder._merges
    monkeypatch.setattr(piece_bpe.Encoder, "_pair", lambda self, key: (calls.append("pair"), pair(self, key))[1])
    monkeypatch.setattr(piece_bpe.Encoder, "_merges", lambda self, *a: (calls.append("merges"), merges(self, *a))[1])
    text = " ".join(words)
    assert piece_bpe.Encoder(vocabulary).encode([text]) == [",".join(map(str, library.encode(text)))]
    assert "pair" not in calls and len(calls) < 100


def test_cost(vocabulary, cost):
    """60,000 new words cost about four sorts of a million numbers; before, some fifteen."""
    rng = np.random.default_rng(1)
    text = " ".join("".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(3, 14, 60000))
    encoders = [piece_bpe.Encoder(vocabulary) for _ in range(3)]
    assert cost(lambda: encoders.pop().encode([text])) < 8


def test_cuts(vocabulary):
    """Texts cut at spaces and line feeds have the parts that the pattern finds."""
    encoder = piece_bpe.Encoder(vocabulary)
    rng = np.random.default_rng(13)
    texts = ["\n", " ", "a", "a \n b", "\n\n a\n", "a\n ", "a ", "\t a\r\n"]
    texts += ["".join(rng.choice(list("ab  \n\t▁"), rng.integers(1, 12), p=[0.3, 0.25, 0.1, 0.1, 0.15, 0.05, 0.05])) for _ in range(3000)]
    for t in texts:
        assert encoder._cut(t) == encoder.cut.findall(piece_bpe.SPACE + t.replace(" ", piece_bpe.SPACE))


def test_long_parts_in_pieces(library, vocabulary):
    """Long parts, met again, beside their own pieces and across texts, keep nothing whole that is cut."""
    texts = ["https://example.com/some/path?x=1&y=2#" + "z" * n for n in (3, 30, 90)] + ["日本語" * 40, "a" * 70 + " " + "a" * 70, "日本語"]
    encoder = piece_bpe.Encoder(vocabulary)
    for _ in range(2):
        assert encoder.encode(texts) == [",".join(map(str, library.encode(t))) for t in texts]
    assert all(len(encoder.cut_long(p)) == 1 for p in encoder.parts)


def test_small_memory_changes_nothing(vocabulary, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcde fgh "), 400)) for _ in range(40)]
    want = piece_bpe.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(piece_bpe, "CACHED_BYTES", 3000)
    monkeypatch.setattr(piece_bpe, "CACHED_PAIRS", 50)
    encoder = piece_bpe.Encoder(vocabulary)
    assert [x for t in texts for x in encoder.encode([t])] == want


def test_decoding_any_ids(library, vocabulary):
    rng = np.random.default_rng(7)
    pool = np.r_[np.arange(300), rng.integers(0, 32000, 80)]
    for _ in range(2000):
        ids = rng.choice(pool, rng.integers(0, 12))
        assert piece_bpe.decode(vocabulary, ids, np.array([0, len(ids)])) == [library.decode(ids.tolist())]


def test_columns(spark, odd, library):
    rows = piece_bpe.decode_column(piece_bpe.encode_column(odd, MODEL), MODEL).collect()
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert collections.Counter((r["doc_id"], r["decoded"]) for r in rows) == texts
    want = {r["doc_id"]: library.encode(r["text"] or "") for r in odd.collect()}
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]] and r["n_tokens"] == len(want[r["doc_id"]]) for r in rows)
