"""Quality rules: base counts of a text, and how a public vocabulary takes to it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import flat, gather, mapped, pieces
from .common import WORD
from .shingles import mix

WORDS = re.compile(WORD)
SYMBOLS = b"#*$%&|<>"
#: Scripts by the first code point of their ranges; a range ends where the next begins.
RANGES = ((0, "other"), (0x41, "latin"), (0x5B, "other"), (0x61, "latin"), (0x7B, "other"), (0xC0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"))
SCRIPTS = sorted({s for _, s in RANGES})


@dataclass(frozen=True)
class Band:
    """What a text of a script may measure: characters per token, byte-fallback share, bits of token entropy."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Wide bands: a vocabulary splits languages that it wasn't made for into short or byte tokens, and that alone is no fault.
BANDS: Mapping[str, Band] = {
    "latin": Band(1.4, 8.0, 0.10, 4.2),
    "greek": Band(0.5, 6.0, 0.60, 3.6),
    "cyrillic": Band(0.8, 6.0, 0.30, 3.8),
    "hebrew": Band(0.4, 6.0, 0.70, 3.2),
    "arabic": Band(0.4, 6.0, 0.70, 3.2),
    "indic": Band(0.25, 6.0, 0.90, 3.2),
    "thai": Band(0.25, 6.0, 0.95, 3.2),
    "hangul": Band(0.25, 6.0, 0.95, 3.2),
    "kana": Band(0.25, 6.0, 0.80, 3.2),
    "han": Band(0.25, 6.0, 0.90, 3.2),
    "other": Band(0.6, 8.0, 0.50, 3.2),
}
#: A task remembers at most so many different words; beyond, it starts again. This bounds memory only.
REMEMBERED = 300_000


class Measure:
    """Counts of texts; remembers the tokens of the words that it has met."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens = (np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.script, self.chars = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        ids = self.model.encode(new, num_threads=1)
        ends = np.cumsum([len(x) for x in ids]) + self.tokens[1][-1]
        self.tokens = np.r_[self.tokens[0], np.array([i for x in ids for i in x], np.int64)], np.r_[self.tokens[1], ends]
        # A word's script is that of its first character that has one.
        begins = np.array([r for r, _ in RANGES])
        names = np.array([SCRIPTS.index(s) for _, s in RANGES])
        codes = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in new])
        kinds = names[np.searchsorted(begins, codes, side="right") - 1]
        other = SCRIPTS.index("other")
        place = np.where(kinds == other, len(codes), np.arange(len(codes)))
        first = np.minimum.reduceat(place, np.cumsum(size) - size)
        self.script = np.r_[self.script, np.where(first < len(codes), kinds[np.minimum(first, len(codes) - 1)], other)]
        self.chars = np.r_[self.chars, size]

    def measure(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        if len(self.known) > REMEMBERED:
            self.clear()
        strings = [t or "" for t in texts.to_pylist()]
        found = [WORDS.findall(t) for t in strings]
        self.learn({w for ws in found for w in ws})
        look, rows = self.known.__getitem__, len(strings)
        n_words = np.array([len(ws) for ws in found], np.int64)
        word = np.array([i for ws in found for i in map(look, ws)], np.int64)
        row = np.repeat(np.arange(rows), n_words)
        data, offsets = flat(texts)
        symbols = np.r_[0, np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))]
        n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
        word_chars = np.bincount(row, weights=self.chars[word], minlength=rows).astype(np.int64)
        # Words in windows of three that the text has twice.
        covered = np.zeros(len(word) + 2, np.int64)
        if len(word) > 2:
            at = np.flatnonzero(row[2:] == row[:-2])
            key = mix(mix(mix(word[at].astype(np.uint64)) + word[at + 1].astype(np.uint64)) + word[at + 2].astype(np.uint64))
            order = np.lexsort((key, row[at]))
            k, r = key[order], row[at][order]
            same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
            twice = at[order[np.r_[same, False] | np.r_[False, same]]]
            for j in range(3):
                covered[twice + j] = 1
        n_repeat = np.bincount(row, weights=covered[: len(word)], minlength=rows).astype(np.int64)
        # Tokens of each text, with those of one kind together.
        starts = self.tokens[1][word]
        lengths = self.tokens[1][word + 1] - starts
        token = gather(self.tokens[0], starts, lengths)
        n_tokens = np.bincount(row, weights=lengths, minlength=rows).astype(np.int64)
        owner = np.repeat(row, lengths)
        n_bytes = np.bincount(owner, weights=self.is_byte[token], minlength=rows).astype(np.float64)
        both = np.sort(owner * len(self.is_byte) + token)
        firsts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        count = np.diff(np.r_[firsts, len(both)])
        of = both[firsts] // len(self.is_byte)
        share = count / n_tokens[of]
        entropy = np.bincount(of, weights=-share * np.log2(share), minlength=rows).astype(np.float64)
        scripts = np.bincount(row * len(SCRIPTS) + self.script[word], weights=self.chars[word], minlength=rows * len(SCRIPTS)).reshape(rows, -1)
        tokens = np.maximum(1, n_tokens)
        return {
            "n_words": n_words,
            "word_chars": word_chars,
            "n_symbols": n_symbols,
            "n_dup_lines": np.array([_repeated_lines(t) for t in strings], np.int64),
            "n_repeat_words": n_repeat,
            "n_tokens": n_tokens,
            "chars_per_token": word_chars / tokens,
            "byte_share": n_bytes / tokens,
            "entropy": entropy,
            "script": [SCRIPTS[i] for i in scripts.argmax(1)],
        }


def _repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return len(lines) - len(set(lines))


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, script string"


def measure(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of each row's whole text; ``path``: a sentencepiece model with byte fallback.

    Tokens are those of each word by itself. Null texts have no words and all counts 0. The script is
    that of most characters, of words by their first letter; ties go to the first by name, so texts
    without words count as "arabic", and rules() rejects them for that lack. The model is read on the driver and
    broadcast; its size is that of the file. Rows stay where they are; other columns are not returned.
    """
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measured = Measure(shared.value)
        for batch in pieces(batches, "text", 2 << 20):
            out = measured.measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v) for v in out.values())], ["doc_id", *out])

    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return mapped(named, run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def rules(docs: DataFrame, path: str, bands: Mapping[str, Band] = BANDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts with base_failed and kept.

    A text fails the base rules with fewer than 50 words, or if over half of its words stand in a
    repeated window of three. Others are kept if all three measures lie in the band of their script.
    """
    counts = measure(docs, path, doc_id, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.lit(False)
    for script, b in bands.items():
        fits = F.col("chars_per_token").between(b.least_chars, b.most_chars) & (F.col("byte_share") <= b.most_bytes) & (F.col("entropy") >= b.least_entropy)
        inside = F.when(F.col("script") == script, fits).otherwise(inside)
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)
