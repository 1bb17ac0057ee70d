"""Byte-level BPE: encoding by batched merge rounds in numpy, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import binary, flat, gather, mapped, pieces

#: How the vocabulary's library cuts a text before merging (fixed by the vocabulary).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1) << 40
#: A space between two characters that aren't white space; white space beside a space or at an end.
CUT, BESIDE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"[^\S ](?: |(?<= [^\S ]))")
#: A task keeps the ids of different parts up to about so many bytes; beyond, it starts again. This bounds memory only.
CACHED_BYTES = 24 << 20
#: What a part or word costs beside its text: its entry, its number and some ids.
ENTRY_BYTES = 160
#: Bytes of text that a task encodes together.
PIECE = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Arrays of a byte-level BPE vocabulary. Its size is fixed by the file, some 2 MB for 50,000 merges."""

    keys: np.ndarray  # sorted pair keys, left * 2^32 + right
    ranks: np.ndarray
    merged: np.ndarray  # the id that a pair becomes
    first: np.ndarray  # the id of each byte
    data: np.ndarray  # bytes of all tokens, one after another
    offsets: np.ndarray
    special: dict[str, int]


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others are numbered from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> Vocabulary:
    """Read a tokenizers file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, chars = spec["model"]["vocab"], byte_characters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    keys = np.array([(ids[a] << 32) + ids[b] for a, b in merges], np.int64)
    merged = np.array([ids[a + b] for a, b in merges], np.int64)
    order = np.argsort(keys, kind="stable")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens: list[bytes] = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for text, i in ids.items():
        tokens[i] = bytes(chars[c] for c in text)
    for text, i in special.items():
        tokens[i] = text.encode()
    first = np.zeros(256, np.int64)
    for c, b in chars.items():
        first[b] = ids[c]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    return Vocabulary(keys[order], order.astype(np.int64), merged[order], first, np.frombuffer(b"".join(tokens), np.uint8), offsets, special)


def _look_up(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and place in the sorted keys of each pair, by binary search."""
    pair = (left.astype(np.int64) << 32) + right
    at = np.minimum(np.searchsorted(v.keys, pair), len(v.keys) - 1)
    return np.where(v.keys[at] == pair, v.ranks[at], NO_RANK), at


def merge_rounds(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, their offsets).

    The symbols of all words lie in one array, each knowing its neighbours in the word. Each round finds
    every word's lowest-rank pair and merges all its places, the left one first where they overlap; then
    only the ranks beside a merge are looked up again. A pair that a merge makes can't have a lower rank
    than that merge, so this is the order of one merge at a time. Words in which nothing is left to merge
    are put aside.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    symbol = v.first[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    done = [(symbol[:0], word[:0])]
    n = len(symbol)
    ends = np.cumsum(sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[sizes > 0] - 1] = -1
    before[(ends - sizes)[sizes > 0]] = -1
    rank, place = np.full(n, NO_RANK), np.zeros(n, np.int64)
    pairs = np.flatnonzero(after >= 0)
    rank[pairs], place[pairs] = _look_up(v, symbol[pairs], symbol[pairs + 1])
    live = np.ones(n, bool)
    starts, counts = (ends - sizes)[sizes > 0], sizes[sizes > 0]
    while len(starts):
        lowest = np.minimum.reduceat(rank, starts)
        open_ = lowest < NO_RANK
        if open_.sum() <= 0.6 * len(open_):  # put aside the words that are finished
            stays = np.repeat(open_, counts)
            out = live & ~stays
            done.append((symbol[out], word[out]))
            keep = live & stays
            moved = np.cumsum(keep) - 1
            counts = np.add.reduceat(keep, starts, dtype=np.int64)[open_] if open_.any() else counts[:0]
            symbol, word, rank, place, after, before = (x[keep] for x in (symbol, word, rank, place, after, before))
            after, before = np.where(after >= 0, moved[after], -1), np.where(before >= 0, moved[before], -1)
            live = np.ones(len(symbol), bool)
            starts, lowest, open_ = np.cumsum(counts) - counts, lowest[open_], open_[open_]
            if not len(starts):
                break
        hit = np.flatnonzero(rank == np.repeat(np.where(open_, lowest, -1), counts))
        # In a run of overlapping places (aaa) every other one is merged, from the left.
        overlaps = np.flatnonzero(after[hit[:-1]] == hit[1:])
        if len(overlaps):
            index = np.arange(len(hit))
            first = np.ones(len(hit), bool)
            first[overlaps + 1] = False
            hit = hit[(index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0]
        gone = after[hit]
        symbol[hit] = v.merged[place[hit]]
        live[gone] = False
        rank[gone] = rank[hit] = NO_RANK
        right = after[hit] = after[gone]
        has = right >= 0
        before[right[has]] = hit[has]
        left = before[hit]
        pairs = np.concatenate([hit[has], left[left >= 0]])
        rank[pairs], place[pairs] = _look_up(v, symbol[pairs], symbol[after[pairs]])
    symbols, owners = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(owners, kind="stable")
    return symbols[order], np.r_[0, np.cumsum(np.bincount(owners, minlength=len(words)))]


class _Numbered(dict):
    """Numbers its keys as they are asked for; taken() gives those that are new since the last call."""

    def __init__(self):
        self.new: list[str] = []
        self.bytes = 0

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        self.bytes += ENTRY_BYTES + len(key)
        return n

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


Lists = tuple[np.ndarray, np.ndarray]  # values of all lists one after another, and the lists' offsets


def _joined(a: Lists, b: Lists) -> Lists:
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1][1:] + len(a[0])])


def _of(lists: Lists, which: np.ndarray) -> Lists:
    starts = lists[1][which]
    lengths = lists[1][which + 1] - starts
    return gather(lists[0], starts, lengths), np.r_[0, np.cumsum(lengths)]


class Encoder:
    """Encodes texts; keeps the ids of the parts that it has met.

    A text is cut at single spaces between two characters that aren't white space. No word of the
    vocabulary's pattern crosses such a cut, and each part after one begins with its space.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(WORDS)
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None
        self.clear()

    def clear(self) -> None:
        self.parts, self.words = _Numbered(), _Numbered()
        for text, i in self.vocabulary.special.items():
            self.parts[text] = len(self.parts)
        ids = np.array(list(self.vocabulary.special.values()), np.int64)
        self.part_ids = (ids, np.arange(len(ids) + 1))
        self.word_ids = (ids[:0], np.zeros(1, np.int64))

    def _parts(self, text: str) -> list[str]:
        # Most texts have no other white space beside a space; then each space is a cut.
        parts = CUT.split(text) if "  " in text or text[:1] == " " or text[-1:] == " " or BESIDE.search(text) else text.split(" ")
        return [parts[0], *[f" {p}" for p in parts[1:]]]

    def _places(self, text: str) -> list[int]:
        if self.special is None or self.special.search(text) is None:
            return list(map(self.parts.__getitem__, self._parts(text)))
        return [p for part in self.special.split(text) for p in ([self.parts[part]] if part in self.vocabulary.special else map(self.parts.__getitem__, self._parts(part)))]

    def _learn(self) -> None:
        """The ids of the new parts: new words are encoded, and a part is its words together."""
        cut = [[self.words[w] for w in self.pattern.findall(p)] for p in self.parts.taken()]
        self.word_ids = _joined(self.word_ids, merge_rounds(self.vocabulary, [w.encode() for w in self.words.taken()]))
        words = np.array([w for ws in cut for w in ws], np.int64)
        ids, ends = _of(self.word_ids, words)
        self.part_ids = _joined(self.part_ids, (ids, ends[np.r_[0, np.cumsum([len(ws) for ws in cut])].astype(np.int64)]))

    def encode(self, texts: list[str | None]) -> Lists:
        """(ids of all texts one after another, their offsets); null is empty."""
        if self.parts.bytes + self.words.bytes > CACHED_BYTES:
            self.clear()
        found = [np.array(self._places(t or ""), np.int64) for t in texts]
        if self.parts.new:
            self._learn()
        ids, ends = _of(self.part_ids, np.concatenate(found) if found else np.zeros(0, np.int64))
        return ids, ends[np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)]


def decode(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of the tokens one after another."""
    return gather(v.data, v.offsets[ids], v.offsets[ids + 1] - v.offsets[ids])


def encode_column(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit integers) of each row's whole text.

    The result is that of the tokenizers library with the file at ``path`` and without added special
    tokens; strings of special tokens in a text become their ids. Null and empty texts have no ids.
    Texts of any length are encoded whole. Rows stay where they are; other columns are not returned.
    The vocabulary is read on the driver and broadcast: its size is that of the file, whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in pieces(batches, "text", PIECE):
            ids, offsets = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), binary(ids.astype("<u4").view(np.uint8), offsets * 4)], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n_tokens long, ids binary")


def _decoded(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The UTF-8 text of each list of ids; bytes that aren't UTF-8 become U+FFFD."""
    ends = np.r_[0, np.cumsum(v.offsets[ids + 1] - v.offsets[ids])][offsets]
    raw = decode(v, ids).tobytes()
    texts = [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
    return texts if _is_text(raw, ends) else [t.decode("utf-8", "replace").encode() for t in texts]


def _is_text(raw: bytes, ends: np.ndarray) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    # No text begins or ends inside a character.
    inner = ends[(ends > 0) & (ends < len(raw))]
    return not (np.frombuffer(raw, np.uint8)[inner] & 0xC0 == 0x80).any()


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encode_column() with their ``decoded`` text. Bytes that aren't UTF-8 become U+FFFD.

    Null ids decode to an empty text; rows stay where they are, and an empty table gives an empty one.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", PIECE):
            data, offsets = flat(batch.column("ids"))
            decoded = _decoded(shared.value, data.view("<u4").astype(np.int64), offsets // 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array([t.decode() for t in decoded], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return mapped(encoded.select("doc_id", "n_tokens", "ids"), run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """What encode_column() and decode_column() give, in one pass: one worker a task and one copy of the vocabulary.

    doc_id, n_tokens, ids (left out without ``with_ids``), ids_sha256 and decoded_sha256 (lowercase hex
    of the ids' bytes and of the decoded text's) for each row of ``docs``. Null and empty texts have no
    ids and the digests of nothing. Repeated rows and ids give equal rows; an empty table gives an empty
    one. Other columns are not used or returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    hexed = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in pieces(batches, "text", PIECE):
            ids, offsets = encoder.encode(batch.column("text").to_pylist())
            packed = ids.astype("<u4").tobytes()
            lists = [packed[4 * a : 4 * b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(offsets))}
            if with_ids:
                columns["ids"] = pa.array(lists, pa.binary())
            columns |= {"ids_sha256": hexed(lists), "decoded_sha256": hexed(_decoded(shared.value, ids, offsets))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, " + "ids binary, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, schema)


def digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What the query returns: counts and digests of the ids and of the text decoded from them; see round_trip()."""
    return round_trip(docs, path, doc_id, text, with_ids=False)
