"""Toxicity: Levenshtein automata run together with a lexicon trie, and scores of context windows.

A lexicon is learned from labelled rows: words, and word beginnings ("stem*"), that toxic texts have and
others don't, in all or in those of a stratum (a script, and a group of texts with like frequent words).
The Levenshtein automata of many words, as rows of bits, walk the lexicon's trie together: each node is
visited once for all words that are still within the edits that a term below it allows, so misspelled
terms are caught.
Each hit is weighed by its window: direct address raises it, quotation marks and words of reporting
lower it. A logistic regression over the sums gives the score.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import mapped, pieces
from .common import held_out, written

WORDS = re.compile(r"[^\W_]+")
#: Words within so many of a hit make its window.
WINDOW = 8
REPORTING = frozenset("said says called calls quote quoted quotes word words wrote writes term terms insult slur sagte sagt wort genannt dit mot écrit appelé dijo dice palabra llamó".split())
ADDRESS = frozenset("you your youre u ur yourself du dich dir dein ihr euch tu toi te vous ton tú ti usted eres sois".split())
#: What ends a quotation that a mark begins; a straight mark pairs within its line.
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", '"': '"'}
MARKS = re.compile(r"(?<!\w)[‘’]|[‘’](?!\w)|[“”„«»\"\n]")
STEM = range(4, 9)
#: What remains of a misspelling's weight where the word is a usual one.
USUAL = 0.001
#: Longer terms allow no edit: the automaton of a word is a row of 64 bits. So many words are read together.
LONGEST, AT_ONCE = 60, 1 << 14
#: A task sends on its counts when they are of so many different things.
COUNTED = 100_000


@dataclass
class Automaton:
    """Words within a small distance of a lexicon's terms.

    ``terms`` are words, or stems that end in "*" and match words they begin. A term of fewer than 4
    characters allows no edit, fewer than 10 one, else two; stems, which any ending fits, allow one from 5
    on, and terms of over LONGEST characters none.
    """

    terms: list[str]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])  # the terms that end at a node
    allowed: list[int] = field(default_factory=lambda: [0])  # the most edits of a term below a node

    def __post_init__(self):
        self.long = {term: t for t, term in enumerate(self.terms) if len(term) > LONGEST}
        for t, term in enumerate(self.terms):
            if term in self.long:
                continue
            node, edits = 0, self.edits(term)
            self.allowed[0] = max(self.allowed[0], edits)
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
            self.ends[node].append(t)

    @staticmethod
    def edits(term: str) -> int:
        if term.endswith("*"):
            return int(len(term) > 5)
        return 0 if len(term) < 4 or len(term) > LONGEST else 1 if len(term) < 10 else 2

    def match(self, words: list[str]) -> np.ndarray:
        """term * 4 + distance + 1 of each word's nearest term, of several the first, or 0."""
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(words), AT_ONCE):
            found.append(self._match(words[at : at + AT_ONCE]))
        out = np.concatenate(found)
        for i, word in enumerate(words):
            if word in self.long:
                out[i] = self.long[word] * 4 + 1
        return out

    def _match(self, words: list[str]) -> np.ndarray:
        """The automaton of a word has a row of bits for each number of edits: bit i says that i characters are read."""
        sizes = np.array([len(w) for w in words])
        kept = np.minimum(sizes, LONGEST + 2).astype(np.uint64)
        one, two = np.uint64(1), np.uint64(2)
        valid = (two << kept) - one
        places = self._places(words, sizes)
        none = np.zeros(len(words), np.uint64)
        distance, term = np.full(len(words), 9), np.zeros(len(words), np.int64)

        def walk(node: int, at: np.ndarray, rows: list[np.ndarray]) -> None:
            for c, child in self.children[node].items():
                same, new = places.get(c, none)[at], []
                for e in range(self.allowed[child] + 1):
                    row = (rows[e] & same) << one
                    if e:
                        row |= rows[e - 1] | rows[e - 1] << one | new[e - 1] << one
                    new.append(row & valid[at])
                alive = np.bitwise_or.reduce(new) != 0
                here = at
                if not alive.all():
                    if not alive.any():
                        continue
                    here, new = at[alive], [row[alive] for row in new]
                for t in self.ends[child]:
                    for e in range(self.edits(self.terms[t]), -1, -1):
                        if self.terms[t].endswith("*"):
                            hit = here[new[e] != 0]
                        else:
                            hit = here[(new[e] >> kept[here] & one == one) & (sizes[here] <= LONGEST + 2)]
                        hit = hit[(distance[hit] > e) | ((distance[hit] == e) & (term[hit] > t))]
                        distance[hit], term[hit] = e, t
                walk(child, here, new)

        # Before the first character of a term e edits may skip as many of the word's.
        walk(0, np.arange(len(words)), [np.full(len(words), (1 << e + 1) - 1, np.uint64) & valid for e in range(self.allowed[0] + 1)])
        return np.where(distance < 9, term * 4 + distance + 1, 0)

    @staticmethod
    def _places(words: list[str], sizes: np.ndarray) -> dict[str, np.ndarray]:
        """For each character the bits of the places at which each word has it."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        short = place < LONGEST + 2
        codes, word, bit = codes[short], word[short], np.uint64(1) << place[short].astype(np.uint64)
        order = np.lexsort((word, codes))
        codes, word, bit = codes[order], word[order], bit[order]
        out: dict[str, np.ndarray] = {}
        if len(codes):
            first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])])
            sums, codes, word = np.add.reduceat(bit, first), codes[first], word[first]
            cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(codes)], strict=True):
                row = out[chr(codes[a])] = np.zeros(len(sizes), np.uint64)
                row[word[a:b]] = sums[a:b]
        return out


FEATURES = ("whole", "stems", "fuzzy", "window", "rate", "quoted", "length")
#: A hit never lowers a score and a quoted one never raises it beyond that: the least and greatest coefficients.
LEAST = np.array([0, 0, 0, 0, 0, -np.inf, -np.inf, -np.inf])
GREATEST = np.array([np.inf, np.inf, np.inf, np.inf, np.inf, 0, np.inf, np.inf])


@dataclass
class Lexicon:
    """Terms, what they weigh as they are and misspelled, and the usual words, which are no misspelling of a term."""

    terms: list[str]
    weights: np.ndarray
    misspelled: np.ndarray
    automaton: Automaton
    usual: dict[str, int] = field(default_factory=dict)  # with the match of each

    @staticmethod
    def of(terms: list[str], weights: np.ndarray) -> Lexicon:
        return Lexicon(terms, weights, weights, Automaton(terms))


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    bias: float

    @property
    def terms(self) -> list[str]:
        return self.lexicon.terms

    def reader(self) -> Reader:
        return Reader(self.lexicon)

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.coefficients + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def quotations(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the quotations of a whole text, in order: each from a mark to the next that ends it.

    A mark that nothing ends begins none; where it comes again before its end the later one counts.
    Apostrophes inside words are no marks.
    """
    found: list[tuple[int, int]] = []
    mark, begin = "", 0
    for m in MARKS.finditer(text):
        c = m.group()
        if c == "\n":
            mark = "" if mark == '"' else mark
        elif mark and c in PAIRS[mark]:
            found.append((begin, m.start()))
            mark = ""
        elif c in PAIRS and (not mark or c == mark):
            mark, begin = c, m.start()
    return found


class Reader:
    """Features of texts under a lexicon; remembers the words that it has met."""

    def __init__(self, lexicon: Lexicon, remembered: int = 500_000):
        self.lexicon, self.terms, self.remembered = lexicon, lexicon.terms, remembered
        self.known = dict(lexicon.usual)

    def learn(self, words: Iterable[str]) -> None:
        """Matches the words that were not met before."""
        if len(self.known) > self.remembered:
            self.known = dict(self.lexicon.usual)
        new = list(set(words).difference(self.known))
        self.known.update(zip(new, self.lexicon.automaton.match(new).tolist(), strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        lowered = [(t or "").lower() for t in texts]
        words = [WORDS.findall(t) for t in lowered]
        self.learn({w for ws in words for w in ws})
        look = self.known.__getitem__
        return np.array([self._one(t, ws, list(map(look, ws))) for t, ws in zip(lowered, words, strict=True)]).reshape(len(texts), len(FEATURES))

    def misspelled(self, text: str | None) -> str | None:
        """The text with one letter of each hit doubled, dropped or replaced, by a hash of the word; None without a hit."""
        lowered, changed = (text or "").lower(), False
        self.learn(WORDS.findall(lowered))

        def edit(m: re.Match) -> str:
            nonlocal changed
            word = m.group()
            if self.known[word] % 4 != 1:
                return word
            changed = True
            how = zlib.crc32(word.encode()) if len(word) > 1 else 0
            at = how // 3 % len(word)
            return word[:at] + (word[at] * 2, "", "x")[how % 3] + word[at + 1 :]

        new = WORDS.sub(edit, lowered)
        return new if changed else None

    def _one(self, text: str, words: list[str], found: list[int]) -> list[float]:
        hits = np.flatnonzero(np.array(found, np.int64)) if any(found) else ()
        length = math.log1p(len(words))
        if not len(hits):
            return [0.0] * 6 + [length]
        places = {i: m.start() for i, m in enumerate(WORDS.finditer(text)) if found[i]}
        quoted_spans = quotations(text)
        whole = stems = fuzzy = quoted = 0.0
        at, value = [], []
        for i in hits.tolist():
            term, distance = divmod(found[i] - 1, 4)
            w = float((self.lexicon.misspelled if distance else self.lexicon.weights)[term])
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            before = bisect.bisect(quoted_spans, (places[i],)) - 1
            if (before >= 0 and places[i] < quoted_spans[before][1]) or not REPORTING.isdisjoint(words[max(0, i - WINDOW) : i]):
                quoted += w
                w *= 0.2
            if not ADDRESS.isdisjoint(near):
                w *= 1.3
            if distance:
                w *= 0.8 ** (distance - 1) * (USUAL if words[i] in self.lexicon.usual else 1)
                fuzzy += w
            elif self.terms[term].endswith("*"):
                stems += w
            else:
                whole += w
            at.append(i)
            value.append(w)
        at_, sums = np.array(at), np.r_[0, np.cumsum(value)]
        window = (sums[np.searchsorted(at_, at_ + 3 * WINDOW, side="right")] - sums[:-1]).max()
        return [math.log1p(whole), math.log1p(stems), math.log1p(fuzzy), math.log1p(window), math.log1p(100 * sums[-1] / len(words)), math.log1p(quoted), length]


@functools.lru_cache(10_000)
def _script(c: str) -> str:
    """LATIN, CYRILLIC, CJK and so on; '' for what is no letter."""
    return unicodedata.name(c, "").partition(" ")[0] if c.isalpha() else ""


def _script_of(words: Iterable[str]) -> str:
    """The script of the most letters of some words; of several the first by name."""
    counts = Counter(map(_script, "".join(words)))
    del counts[""]
    return min(counts, key=lambda s: (-counts[s], s), default="")


@dataclass
class Strata:
    """Groups of texts of one script with like frequent words, learned from the texts alone."""

    markers: dict[str, dict[str, int]] = field(default_factory=dict)  # by script: frequent words and their places
    centres: dict[str, np.ndarray] = field(default_factory=dict)

    def vector(self, words: frozenset[str] | set[str], script: str) -> np.ndarray:
        places = self.markers.get(script, {})
        out = np.zeros(len(places), np.float32)
        out[[places[w] for w in words if w in places]] = 1
        return out

    def of(self, words: frozenset[str] | set[str]) -> list[str]:
        """The strata of a text: its script, and the group in it."""
        script = _script_of(words)
        if script not in self.centres:
            return [script]
        return [script, f"{script} {int((self.centres[script] @ self.vector(words, script)).argmax())}"]


def _mapped(sample: DataFrame, per_text: Callable[[set[str], int], Iterable[tuple]], columns: dict[str, str], counted: bool = False) -> DataFrame:
    """What ``per_text`` gives for the words and label of each text; ``counted``: each once with its number, n, by task."""
    names = [*columns, "n"] if counted else list(columns)
    schema = ", ".join(f"{c} {t}" for c, t in columns.items()) + (", n long" if counted else "")
    kinds = {"string": pa.string(), "int": pa.int32(), "array<float>": pa.list_(pa.float32())}
    arrow = pa.schema([(c, kinds[t]) for c, t in columns.items()] + [("n", pa.int64())] * counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            rows: list[tuple] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = per_text(set(WORDS.findall((text or "").lower())), toxic)
                counts.update(found) if counted else rows.extend(found)
                if len(counts) > COUNTED:
                    rows, counts = [(*k, n) for k, n in counts.items()], Counter()
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=arrow)
        if counts:
            rows = [(*k, n) for k, n in counts.items()]
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=arrow)

    return mapped(sample.select("text", "toxic"), run, schema)


def strata(sample: DataFrame, groups: int = 6, frequent: int = 48, rows: int = 4000) -> Strata:
    """Spherical k-means over which of a script's ``frequent`` commonest words a text has.

    At most ``rows`` texts of a script are looked at, by a hash; the centres are found on the driver.
    """
    scripts = lambda words, _: ((script, w) for script in [_script_of(words)] if script for w in words)
    common = _mapped(sample, scripts, {"script": "string", "word": "string"}, counted=True).groupBy("script", "word").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("script").orderBy(F.desc("n"), "word")
    found = Strata()
    for r in common.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= frequent).orderBy("script", "at").collect():
        places = found.markers.setdefault(r["script"], {})
        places[r["word"]] = len(places)

    def vectors(words: set[str], _: int) -> Iterable[tuple]:
        script = _script_of(words)
        return [(script, found.vector(words, script).tolist())] if script else []

    each = _mapped(sample, vectors, {"script": "string", "v": "array<float>"})
    w = Window.partitionBy("script").orderBy(F.xxhash64("v"), "v")
    seen: dict[str, list] = {}
    for r in each.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= rows).orderBy("script", "at").collect():
        seen.setdefault(r["script"], []).append(r["v"])
    for script, vs in seen.items():
        x = np.array(vs, np.float32)
        x = x[x.any(1)]
        if len(x) < 2:
            continue
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        # Each first centre is the text least like the ones before it; the first is the most usual.
        at = [int((x @ x.mean(0)).argmax())]
        while len(at) < min(groups, len(x)):
            near = (x @ x[at].T).max(1)
            if near.min() > 0.9:
                break
            at.append(int(near.argmin()))
        centres = x[at]
        for _ in range(12):
            own = (x @ centres.T).argmax(1)
            sums = np.array([x[own == g].sum(0) if (own == g).any() else centres[g] for g in range(len(at))])
            centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        found.centres[script] = centres
    return found


def chance(a: int, b: int, bad: int, good: int) -> float:
    """How likely at least ``a`` of a + b rows are toxic by chance, where ``bad`` of bad + good are."""
    share, n = bad / (bad + good), a + b
    if not good:
        return 1.0
    i = np.arange(a, n + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in i.tolist()]) + i * math.log(share) + (n - i) * math.log1p(-share)
    return float(np.exp(logs).sum())


def lexicon(sample: DataFrame, most: int = 300, support: float = 0.002, level: float = 0.01, own: int = 60) -> tuple[list[str], np.ndarray]:
    """The terms of toxic rows and their weights (log odds).

    A term must be in ``support`` of the toxic rows (3 at least), there six times as often as in others,
    and in so many of them by chance with a likelihood of ``level`` at most; all three are shares, so the
    rule is the same for few rows and many. It is judged over all rows and within each stratum (see
    Strata), so terms of a language with few rows are found too: those need twice the frequency over all
    rows and have the smaller of both weights. Of terms that begin one another the one with the most
    evidence (rows times log odds) stays, of equal ones the word. The size of the lexicon, and so of the
    automaton, is a parameter: the ``most`` strongest over all rows and the ``own`` strongest of each
    stratum are taken. What is collected is bounded by the sample and ``support``.
    """
    groups = strata(sample)
    size: Counter = Counter()
    for r in _mapped(sample, lambda words, toxic: [(s, toxic) for s in (None, *groups.of(words))], {"stratum": "string", "toxic": "int"}, counted=True).groupBy("stratum", "toxic").agg(F.sum("n").alias("n")).collect():
        size[r["stratum"], r["toxic"]] = r["n"]
    if not size[None, 1]:
        return [], np.zeros(0)

    def terms(words: set[str], toxic: int) -> Iterable[tuple]:
        found = words | {f"{w[:n]}*" for w in words for n in STEM if len(w) > n}
        own = (None, *groups.of(words))
        return [(t, s, toxic) for t in found for s in own]

    counts = _mapped(sample, terms, {"term": "string", "stratum": "string", "toxic": "int"}, counted=True)
    total = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    counts = written(counts.groupBy("term", "stratum").agg(total(1).alias("bad"), total(0).alias("good")).filter("bad > 0"), "toxicity-terms")
    candidate = F.lit(False)
    for s, n in [(s, n) for (s, toxic), n in size.items() if toxic == 1]:
        odds_of = F.ln((F.col("bad") + 0.5) / (n + 1)) - F.ln((F.col("good") + 0.5) / (size[s, 0] + 1))
        candidate = candidate | (F.col("stratum").eqNullSafe(F.lit(s)) & (F.col("bad") >= max(3, support * n)) & (odds_of >= math.log(6)))
    overall_of = counts.filter("stratum IS NULL").select("term", F.col("bad").alias("all_bad"), F.col("good").alias("all_good"))
    rows = counts.filter(candidate).join(overall_of, "term").collect()

    def odds(a: int, b: int, s: str | None) -> float:
        return math.log((a + 0.5) / (size[s, 1] + 1)) - math.log((b + 0.5) / (size[s, 0] + 1))

    scored: dict[str | None, list] = {}
    for r in rows:
        term, s, weight = r["term"], r["stratum"], odds(r["bad"], r["good"], r["stratum"])
        if chance(r["bad"], r["good"], size[s, 1], size[s, 0]) > level:
            continue
        evidence = r["bad"] * weight
        if s is not None:
            overall = odds(r["all_bad"], r["all_good"], None)
            if overall < math.log(2):
                continue
            weight = min(weight, overall)
        scored.setdefault(s, []).append((-evidence, term.endswith("*"), term, weight))
    chosen: dict[str, float] = {}
    stems: set[str] = set()
    begun: set[str] = set()
    for s in sorted(scored, key=lambda s: (s is not None, s or "")):
        taken = 0
        for *_, term, weight in sorted(scored[s]):
            word = term.removesuffix("*")
            if term in chosen:
                taken += 1
            elif not any(word[:n] in stems for n in range(1, len(word) + 1)) and not (term.endswith("*") and word in begun):
                chosen[term] = weight
                taken += 1
                if term.endswith("*"):
                    stems.add(word)
                begun.update(word[:n] for n in range(1, len(word) + 1))
            if taken == (most if s is None else own):
                break
    return list(chosen), np.array(list(chosen.values()))


def _with_features(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """toxic and the features of each row of the sample, and again of each toxic row with its terms misspelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in pieces(batches, "text"):
            texts, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            # All words at once: the automata of many walk the trie together.
            reader.learn({w for t in texts for w in WORDS.findall((t or "").lower())})
            again = [new for t, y in zip(texts, toxic, strict=True) if y and (new := reader.misspelled(t))]
            values = reader.features([*texts, *again])
            yield pa.RecordBatch.from_arrays([pa.array([*toxic, *[1] * len(again)], pa.int32()), *(pa.array(v) for v in values.T)], ["toxic", *FEATURES])

    return mapped(sample.select("text", "toxic"), run, ", ".join(["toxic int", *(f"{f} double" for f in FEATURES)]))


def usual_words(sample: DataFrame, automaton: Automaton, support: float = 0.001, least: int = 5, most: int = 100_000) -> dict[str, int]:
    """The words that clean rows of the sample have in common (``least`` rows and a share of ``support``), with their matches.

    These are spelled as they are meant, so near a term they weigh next to nothing. They are as many as the
    sample gives, ``most`` at the utmost.
    """
    clean = sample.filter("toxic = 0")
    rows = clean.count()
    words = _mapped(clean, lambda words, _: ((w,) for w in words), {"word": "string"}, counted=True).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(least, support * rows))
    found = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(most).collect()]
    return dict(zip(found, automaton.match(found).tolist(), strict=True))


def learned_misspellings(sample: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """What a term weighs where it is met by an edit: by how many toxic rows have it, and how many clean rows meet it so.

    A term near which many clean words are thus weighs little or nothing: its log odds less their
    standard error, but never more than the term itself and never less than 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Reader(lexicon), Counter()
        for batch in batches:
            words = [set(WORDS.findall((t or "").lower())) for t in batch.column("text").to_pylist()]
            reader.learn(set().union(*words))
            for ws, toxic in zip(words, batch.column("toxic").to_pylist(), strict=True):
                codes = {c for w in ws if (c := reader.known[w]) % 4 == 1 or (c and w not in lexicon.usual)}
                counts.update({((c - 1) // 4, toxic) for c in codes if (c % 4 == 1) == bool(toxic)})
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.int32()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["term", "toxic", "n"])

    rows = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = np.zeros(len(lexicon.terms), int), np.zeros(len(lexicon.terms), int)
    for r in mapped(sample.select("text", "toxic"), run, "term int, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n")).collect():
        (bad if r["toxic"] else good)[r["term"]] = r["n"]
    out = np.zeros(len(lexicon.terms))
    for t, (a, b) in enumerate(zip(bad.tolist(), good.tolist(), strict=True)):
        odds = math.log((a + 0.5) / (rows.get(1, 0) + 1)) - math.log((b + 0.5) / (rows.get(0, 0) + 1))
        out[t] = min(max(0.0, odds - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))), lexicon.weights[t])
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) is no multiple of 5.

    At most about ``sample_rows`` rows of each label are looked at, chosen by a hash of their id and text;
    equal rows of one id count once. This bounds what the driver gets: counts of candidate terms,
    frequent words of at most 4000 rows of each script, and seven numbers for each row of the sample.
    The lexicon has at most 300 terms over all rows and 60 of each stratum; see lexicon().
    An id with several labels counts as toxic if one of them says so; null labels and ids are left out.
    Without a toxic or without a clean row every score is the share of toxic rows.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(toxic).cast("int").alias("toxic")).filter("_id IS NOT NULL AND toxic IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).filter(~held_out("_id"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, sample_rows / max(1, total.get(1, 0))).otherwise(sample_rows / max(1, total.get(0, 0)))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1 << 30)) < share * (1 << 30))
    # Two columns of about 2 * sample_rows rows: small enough to broadcast whatever the input.
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "_id")
    # An id may have any number of rows: these are drawn from again, so the bound is one of rows.
    sample = written(sample.dropDuplicates(["_id", "text"]), "toxicity-rows")
    rows = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if max(rows.values(), default=0) > 1.5 * sample_rows:
        share = F.when(F.col("toxic") == 1, sample_rows / max(1, rows.get(1, 0))).otherwise(sample_rows / max(1, rows.get(0, 0)))
        sample = written(sample.filter(F.pmod(F.xxhash64(F.lit("rows"), "_id", "text"), F.lit(1 << 30)) < share * (1 << 30)), "toxicity-sample")
    sample = sample.select("text", "toxic")
    found = Lexicon.of(*lexicon(sample))
    base = total.get(1, 0) / max(1, sum(total.values()))
    flat = Model(found, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), math.log((base + 1e-3) / (1 - base + 1e-3)))
    if not found.terms:
        return flat
    found.usual = usual_words(sample, found.automaton)
    found.misspelled = learned_misspellings(sample, found)
    rows = _with_features(sample, found).toPandas()
    if rows["toxic"].nunique() < 2:
        return flat
    x, y = rows[list(FEATURES)].to_numpy(), rows["toxic"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    # Rows of each label weigh as many as there are in all.
    weight = np.where(y == 1, total[1] / y.sum(), total[0] / (1 - y).sum())
    weight /= weight.mean()
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    theta = regression(np.c_[(x - mean) / scale, np.ones(len(x))], y, weight, np.r_[np.full(len(FEATURES), 1.0), 1e-6])
    return Model(found, mean, scale, theta[:-1], float(theta[-1]))


def regression(design: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic regression whose coefficients stay between LEAST and GREATEST: one at a time by Newton's method."""
    theta, z = np.zeros(design.shape[1]), np.zeros(len(design))
    for _ in range(rounds):
        before = theta.copy()
        for j in range(len(theta)):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            gradient = design[:, j] @ (weight * (p - y)) + ridge[j] * theta[j]
            curve = (design[:, j] ** 2) @ (weight * p * (1 - p)) + ridge[j]
            new = np.clip(theta[j] - np.clip(gradient / max(curve, 1e-9), -1, 1), LEAST[j], GREATEST[j])
            z += design[:, j] * (new - theta[j])
            theta[j] = new
        if np.abs(theta - before).max() < 1e-6:
            break
    return theta


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text. Null and empty texts get the score of no hits."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(reader.features(batch.column("text").to_pylist())))], ["doc_id", "score"])

    return mapped(named, run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``limit``. Rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in pieces(batches, text):
            scores = model.scores(reader.features(batch.column(batch.schema.get_field_index(text)).to_pylist()))
            yield batch.filter(pa.array(scores < limit))

    return mapped(docs, run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; see fit() for what is learned from."""
    scored = score(docs, fit(docs, labels, doc_id=doc_id, text=text), doc_id, text)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
