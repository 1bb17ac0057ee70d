"""SentencePiece models of merge type: encoding by merge rounds or by a table of prefixes, and decoding.

Short parts of texts are merged side by side, one merge of each in a round. In long ones that would be
quadratic: every prefix of a text has one encoding, and it ends in one token, the one that fits the token
before it. So a single walk over a long part fills a table with the last token of each prefix, and the ids
are read from the table backwards, with no merging.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import binary, flat, gather, mapped, pieces

SPACE = "▁"
#: Kinds of pieces in a model's file (fixed by its format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A task keeps the ids of different parts up to about so many bytes, and so many tested pairs. This bounds memory only.
CACHED_BYTES, CACHED_PAIRS = 128 << 20, 600_000
#: What a part costs beside its text and ids.
ENTRY_BYTES = 200
#: Parts of so many characters are cut further before they are encoded.
LONG = 24
#: Parts up to so many characters are merged together, longer ones are walked each by itself.
TOGETHER = 64
#: Bytes of text that a task encodes together.
PIECE = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model. Its size is fixed by the file, some 3 MB for 32,000 pieces."""

    scores: dict[str, float]  # of the pieces that merging can make
    ids: dict[str, int]
    byte_ids: tuple[int, ...]  # the id of each byte, for characters that are no pieces
    data: np.ndarray  # what each id decodes to, one after another
    offsets: np.ndarray
    begins_with_space: np.ndarray  # ids whose piece begins with the mark of a space
    neighbours: np.ndarray  # sorted keys, left * 2^32 + right, of characters that are side by side in a piece
    pieces: list[str]  # by id


def _number(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(raw):
        key, at = _number(raw, at)
        if key & 7 == 0:
            value, at = _number(raw, at)
        else:
            size, at = _number(raw, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def load(path: str) -> Vocabulary:
    """Read a SentencePiece model file.

    It must be of merge type with byte fallback, a space before the text, and no other changes to the
    text (no character map, no folding of white space, no symbols of the user's own); else ValueError.
    """
    with open(path, "rb") as f:
        raw = f.read()
    found, settings = [], {2: {}, 3: {}}
    for field, value in _fields(raw):
        if field == 1:
            piece = dict(_fields(value))
            found.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif field in settings:
            settings[field] = dict(_fields(value))
    trainer, normalizer = settings[2], settings[3]
    plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
    if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or not plain or any(kind in (USER_DEFINED, UNUSED) for *_, kind in found):
        raise ValueError("the model must be of merge type with byte fallback, and leave texts as they are but for spaces")
    surface = trainer.get(44, " ⁇ ".encode())
    scores = {piece: score for piece, score, kind in found if kind == NORMAL}
    tokens = [piece.replace(SPACE, " ").encode() if kind == NORMAL else bytes([int(piece[3:-1], 16)]) if kind == BYTE else surface if kind == UNKNOWN else b"" for piece, _, kind in found]
    byte_ids = {int(piece[3:-1], 16): i for i, (piece, _, kind) in enumerate(found) if kind == BYTE}
    pairs = {(ord(a) << 32) + ord(b) for piece in scores for a, b in zip(piece, piece[1:], strict=False)}
    return Vocabulary(
        scores,
        {piece: i for i, (piece, _, kind) in enumerate(found) if kind == NORMAL},
        tuple(byte_ids[b] for b in range(256)),
        np.frombuffer(b"".join(tokens), np.uint8),
        np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int64),
        np.array([kind == NORMAL and piece.startswith(SPACE) for piece, _, kind in found]),
        np.array(sorted(pairs), np.int64),
        [piece for piece, *_ in found],
    )


@dataclass(frozen=True)
class History:
    """How merging makes a token: the score of each merge, and the first and last symbol before and after each."""

    scores: tuple[float, ...]
    firsts: tuple[str, ...]
    lasts: tuple[str, ...]
    whole: bool  # one symbol is left: the token's own text encodes to it


#: Numbers of tokens are below this; so is the number that stands for the beginning of a part.
NUMBERS = 1 << 21
#: The rank of pairs that don't merge, after all others.
NEVER = 1 << 30


class Encoder:
    """Encodes texts; keeps the ids of the parts and the pairs of tokens that it has met.

    Tokens are numbered: a piece by its id, and a character that is no piece by its code point plus the
    number of ids. ``begin`` stands for what is before the first token of a part.
    """

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        many = {p: i for p, i in v.ids.items() if len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        for piece, i in many.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        single = sorted((ord(p), i) for p, i in v.ids.items() if len(p) == 1)
        self.single_codes, self.single_ids = np.array([c for c, _ in single], np.int64), np.array([i for _, i in single], np.int64)
        self.sizes = [len(p) for p in v.pieces]
        self.begin = len(v.pieces) + 0x110000
        if self.begin >= NUMBERS:
            raise ValueError("too many pieces")
        self.decimal = [str(i) for i in range(len(v.pieces))]
        # What two neighbouring tokens merge into, for all that do: sorted keys, left * NUMBERS + right, and the order of merges.
        number = {p: i for p, i in v.ids.items()} | {c: ord(c) + len(v.pieces) for p in many for c in p if c not in v.ids}
        merges = sorted((number[p[:i]] * NUMBERS + number[p[i:]], piece) for p, piece in many.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        place = {score: i for i, score in enumerate(sorted({v.scores[p] for p in many}, reverse=True))}
        self.merge_keys, self.merge_ids = (np.array(x, np.int64) for x in (zip(*merges, strict=True) if merges else ((0,), (0,))))
        self.merge_ranks = np.array([place[v.scores[v.pieces[i]]] if merges else 0 for i in self.merge_ids.tolist()], np.int64)
        self.histories: dict[str, History] = {}
        # No piece has a space after another character, nor, mostly, a line feed: no token crosses such places.
        crossed = any(SPACE in p.lstrip(SPACE) for p in v.scores)
        lines = not any("\n" in p for p in v.scores)
        self.words = lines and not crossed
        self.cut = None if crossed else re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.parts: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.pairs: dict[int, bool] = {}
        self.bytes = 0

    def history(self, token: str) -> History:
        """Merges the token's own characters: the best pair first, the left one of equals."""
        found = self.histories.get(token)
        if found is None:
            score, symbols = self.vocabulary.scores.get, list(token)
            scores, firsts, lasts = [], [symbols[0]], [symbols[-1]]
            while len(symbols) > 1:
                best, at = max((score(a + b, -math.inf), -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
                if best == -math.inf:
                    break
                symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
                scores.append(best)
                firsts.append(symbols[0])
                lasts.append(symbols[-1])
            found = History(tuple(scores), tuple(firsts), tuple(lasts), len(symbols) == 1)
            if token in self.vocabulary.scores:  # so these are no more than the pieces
                self.histories[token] = found
        return found

    def fits(self, left: str, right: str) -> bool:
        """True where the two tokens' texts together encode to just these two.

        Both are merged side by side, the better merge first, as they would be in one text. They don't
        fit if at some point the symbols that meet in the middle make a better pair than the next merge
        on either side. Of equal pairs the left one goes first.
        """
        a, b, score = self.history(left), self.history(right), self.vocabulary.scores.get
        i = j = 0
        while True:
            in_left = a.scores[i] if i < len(a.scores) else -math.inf
            in_right = b.scores[j] if j < len(b.scores) else -math.inf
            across = score(a.lasts[i] + b.firsts[j])
            if across is not None and across > in_left and across >= in_right:
                return False
            if in_left == in_right == -math.inf:
                return a.whole and b.whole
            if in_left >= in_right:
                i += 1
            else:
                j += 1

    def _name(self, number: int) -> str:
        return self.vocabulary.pieces[number] if number < len(self.decimal) else chr(number - len(self.decimal))

    def _pair(self, key: int) -> bool:
        """fits() of two numbers, left * NUMBERS + right, remembered."""
        left, right = divmod(key, NUMBERS)
        known = self.history(self._name(right)).whole if left == self.begin else self.fits(self._name(left), self._name(right))
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[key] = known
        return known

    def _characters(self, text: str) -> np.ndarray:
        """The number of each character."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.single_codes, codes), len(self.single_codes) - 1)
        return np.where(self.single_codes[at] == codes, self.single_ids[at], codes + len(self.decimal))

    def _backwards(self, last: list[int]) -> str:
        """The ids of a part in decimal: its last token, the last token of what is before that, and so on."""
        found, at, decimal, sizes = [], len(last) - 1, self.decimal, self.sizes
        while at >= 0:
            token = last[at]
            if token < len(decimal):
                found.append(decimal[token])
                at -= sizes[token]
            else:
                found.extend(decimal[self.vocabulary.byte_ids[b]] for b in reversed(chr(token - len(decimal)).encode()))
                at -= 1
        found.reverse()
        return ",".join(found)

    def walk_one(self, part: str) -> str:
        """The ids of a part, its prefixes one after another; see walk()."""
        last, settled, pairs = self._characters(part).tolist(), -1, self.pairs.get
        sizes = self.sizes
        for end, piece in self.automaton.iter(part):
            if end != settled:
                start = end - sizes[piece]
                key = (last[start] if start >= 0 else self.begin) * NUMBERS + piece
                known = pairs(key)
                if self._pair(key) if known is None else known:
                    last[end], settled = piece, end
        return self._backwards(last)

    def _merges(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank * 2^32 + ``at``, the merged id) of each pair of numbers; a pair that doesn't merge has the rank NEVER."""
        keys = left * NUMBERS + right
        found = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
        return (np.where(self.merge_keys[found] == keys, self.merge_ranks[found], NEVER) << 32) + at, self.merge_ids[found]

    def walk(self, parts: list[str]) -> list[str]:
        """The ids of each part, in decimal, joined by commas.

        The symbols of all parts lie in one array, with ``begin``, which merges with nothing, around each part.
        Each round does the best merge of every part, of equals the left one; then only the two pairs beside
        it are looked up. Parts in which nothing is left to merge are put aside.
        """
        if not parts:
            return []
        sizes = np.array([len(p) for p in parts], np.int64)
        begins = np.cumsum(sizes + 1) - sizes
        total = int(sizes.sum()) + len(parts) + 1
        inside = np.ones(total, bool)
        inside[begins - 1] = inside[-1] = False
        symbol = np.full(total, self.begin, np.int64)
        symbol[inside] = self._characters("".join(parts))
        result = np.full(total, -1, np.int64)  # by first place; -1 where a token goes on
        home = at = np.arange(total)
        before, after = at - 1, at + 1  # of the first and last symbol not used
        order, merged = self._merges(symbol[:-1], symbol[1:], at[:-1])
        starts = begins - 1
        while True:
            best = np.minimum.reduceat(order, starts)
            going = best < NEVER << 32
            if going.sum() <= 0.7 * len(going):  # put aside what is ready
                lengths = np.diff(np.r_[starts, len(symbol) - 1])
                stays = np.r_[np.repeat(going, lengths), True]
                alive = symbol >= 0
                out = alive & ~stays
                result[home[out]] = symbol[out]
                if not going.any():
                    break
                keep = alive & stays
                moved = np.cumsum(keep) - 1
                starts = moved[starts[going]]
                home, symbol = home[keep], symbol[keep]
                order = (order[keep[:-1]] & -1 << 32) + np.arange(len(symbol) - 1)
                merged = merged[keep[:-1]]
                before, after = np.arange(-1, len(symbol) - 1), np.arange(1, len(symbol) + 1)
                best = np.minimum.reduceat(order, starts)
                going = best < NEVER << 32
            hit = best[going] & 0xFFFFFFFF
            gone = after[hit]
            symbol[hit] = merged[hit]
            symbol[gone] = -1
            order[gone] = NEVER << 32
            right, left = after[gone], before[hit]
            after[hit], before[right] = right, hit
            order[hit], merged[hit] = self._merges(symbol[hit], symbol[right], hit)
            order[left], merged[left] = self._merges(symbol[left], symbol[hit], left)
        tokens = result[inside]
        there = tokens >= 0
        ends = np.r_[0, np.cumsum(there)][np.r_[0, np.cumsum(sizes)]].tolist()
        decimal, pieces = self.decimal, len(self.decimal)
        names = [decimal[t] if t < pieces else ",".join(decimal[self.vocabulary.byte_ids[b]] for b in chr(t - pieces).encode()) for t in tokens[there].tolist()]
        return [",".join(names[a:b]) for a, b in itertools.pairwise(ends)]

    def cut_long(self, part: str) -> list[str]:
        """A long part cut where its neighbouring characters are side by side in no piece."""
        if len(part) < LONG:
            return [part]
        codes = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.int64)
        keys, known = (codes[:-1] << 32) + codes[1:], self.vocabulary.neighbours
        cuts = np.flatnonzero(known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] != keys) + 1
        return [part[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True)]

    def _cut(self, text: str) -> list[str]:
        """Parts of a text that is not empty: a token of the whole text is one of a part."""
        if self.words and text[0] != " " and "  " not in text and SPACE not in text:
            if "\n" not in text:
                return [SPACE + w for w in text.split(" ")]
            first, *others = text.split("\n")
            parts = [SPACE + w for w in first.split(" ")]
            for line in others:
                word, *words = line.split(" ")
                parts.append("\n")
                if word:
                    parts.append(word)
                parts.extend([SPACE + w for w in words])
            return parts
        marked = SPACE + text.replace(" ", SPACE)
        return self.cut.findall(marked) if self.cut else [marked]

    def _learn(self, parts: set[str]) -> None:
        """Remember the ids of parts that ``self.parts`` doesn't have."""
        older = self.older
        kept = [p for p in parts if p in older]
        new = parts.difference(kept) if kept else parts
        long = [p for p in new if len(p) > TOGETHER]
        short = list(new.difference(long) if long else new)
        for some, ids in ((kept, [older[p] for p in kept]), (short, self.walk(short)), (long, [self.walk_one(p) for p in long])):
            self.parts.update(zip(some, ids, strict=True))
            self.bytes += ENTRY_BYTES * len(some) + sum(map(len, some)) + sum(map(len, ids))

    def encode(self, texts: list[str | None]) -> list[str]:
        """The ids of each text in decimal, joined by commas; null and empty texts have none.

        When half the bytes are used, the parts kept before the last such time are forgotten. Long parts
        are kept in pieces.
        """
        if self.bytes > CACHED_BYTES // 2:
            self.older, self.parts, self.bytes = self.parts, {}, 0
        found = [self._cut(text) if text else [] for text in texts]
        new = set().union(*found).difference(self.parts)
        long = {part: self.cut_long(part) for part in new if len(part) >= LONG}
        self._learn(new.difference(long).union(*long.values()).difference(self.parts))
        known = self.parts.__getitem__
        joined = {part: ",".join(map(known, pieces)) for part, pieces in long.items()}
        self.parts.update(joined)
        encoded = [",".join(map(known, ps)) for ps in found]
        for part, pieces in long.items():
            if len(pieces) > 1:
                del self.parts[part]
        return encoded


#: The encoder of the last vocabulary of this process: a worker that runs one task after another goes on with what it knows.
_kept: list[Encoder] = []


def _encoder(vocabulary: Vocabulary) -> Encoder:
    if not _kept or _kept[0].vocabulary is not vocabulary:
        _kept[:] = [Encoder(vocabulary)]
    return _kept[0]


def _one_mark_a_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("one_mark_a_byte", _one_mark_a_byte)


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The text of each list of ids, whose values lie one after another.

    The space before the first piece is dropped. Each byte that is no part of a UTF-8 character becomes
    U+FFFD; control ids are empty, and the unknown id has the model's own sign.
    """
    width = v.offsets[ids + 1] - v.offsets[ids]
    raw = gather(v.data, v.offsets[ids], width).tobytes()
    ends = np.r_[0, np.cumsum(width)]
    texts = []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        while a < b and not width[a]:
            a += 1
        start = int(ends[a]) + int(a < b and v.begins_with_space[ids[a]])
        # No character goes on across an id that is empty.
        cuts = [start, *ends[a:b][width[a:b] == 0].tolist(), int(ends[b])]
        texts.append("".join(raw[x:y].decode("utf-8", "one_mark_a_byte") for x, y in zip(cuts, cuts[1:], strict=False)))
    return texts


def encode_column(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (binary: little-endian unsigned 32-bit integers) of each row's whole text.

    The ids are those of the sentencepiece library with the model at ``path``, without begin and end ids.
    Null and empty texts have none; texts of any length are encoded whole. Rows stay where they are,
    repeated ones give equal rows, an empty table gives an empty one, and other columns are not returned.
    The model is read on the driver and broadcast: its size is that of the file, whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in pieces(batches, "text", PIECE):
            lists = [_numbers(x) for x in encoder.encode(batch.column("text").to_pylist())]
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
            packed = np.concatenate(lists).astype("<u4").view(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), binary(packed, offsets * 4)], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n_tokens long, ids binary")


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encode_column() with their ``decoded`` text; see decode(). Null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", PIECE):
            data, offsets = flat(batch.column("ids"))
            decoded = decode(shared.value, data.view("<u4").astype(np.int64), offsets // 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return mapped(encoded.select("doc_id", "n_tokens", "ids"), run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def _numbers(joined: str) -> np.ndarray:
    return np.fromstring(joined, np.int64, sep=",")


def digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What the query returns, in one pass: doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row.

    The digests are those of the ids in decimal, joined by commas, and of the text decoded from the ids.
    Null and empty texts have no ids and the digests of nothing; repeated rows give equal rows; an empty
    table gives an empty one. Other columns are not used or returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    hexed = lambda values: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in pieces(batches, "text", PIECE):
            joined = encoder.encode(batch.column("text").to_pylist())
            lists = [_numbers(x) for x in joined]
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
            decoded = decode(shared.value, np.concatenate(lists), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), hexed(joined), hexed(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
