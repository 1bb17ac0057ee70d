"""Language identification by a bidirectional gated recurrent network over bytes, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import flat, mapped, pieces
from .common import held_out

LETTER = regex.compile(r"\p{L}")
#: Bytes that the network reads in one go when it labels, and when it learns; then its states start anew.
WINDOW, LESSON = 128, 64
UNITS = 8
UNKNOWN = "und"


@dataclass
class Network:
    """Weights. ``table`` has, for each byte, the input's share of the gates and of the candidate.

    Of a direction: gates r and z (halved, so that one tanh serves them too), candidate n, and the
    state h' = n + z (h - n). At each position both directions' states give the label's logits.
    """

    labels: list[str]
    tables: list[np.ndarray]  # 256 x 3 UNITS for each direction
    loops: list[np.ndarray]  # UNITS x 3 UNITS
    outs: list[np.ndarray]  # UNITS x labels
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.loops, *self.outs, self.bias]


def start(labels: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5 if shape[0] < 256 else 0.4, shape).astype(np.float32)
    n = len(labels)
    return Network(labels, [draw(256, 3 * UNITS) for _ in "fb"], [draw(UNITS, 3 * UNITS) for _ in "fb"], [draw(UNITS, n) for _ in "fb"], np.zeros(n, np.float32))


def _gates(a: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(new state, r, z, n); ``a``: from the table, ``g``: h times the loop."""
    rz = np.tanh(a[:, : 2 * UNITS] + g[:, : 2 * UNITS])
    rz *= 0.5
    rz += 0.5
    r, z = rz[:, :UNITS], rz[:, UNITS:]
    n = r * g[:, 2 * UNITS :]
    n += a[:, 2 * UNITS :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, r, z, n


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def _run(table: np.ndarray, loop: np.ndarray, x: np.ndarray) -> list[tuple]:
    """States of one direction over lessons of equal length, with what going back needs."""
    h = np.zeros((x.shape[1], UNITS), np.float32)
    trace = []
    for row in x:
        g = h @ loop
        new, r, z, n = _gates(table[row], g, h)
        trace.append((h, g, r, z, n, new))
        h = new
    return trace


def _back(loop: np.ndarray, x: np.ndarray, trace: list[tuple], above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and loop by going back through time; ``above``: of the states from the labels."""
    d_loop, d_inputs = np.zeros_like(loop), np.empty((*x.shape, 3 * UNITS), np.float32)
    carried = np.zeros_like(above[0])
    for t in range(len(x) - 1, -1, -1):
        h, g, r, z, n, _ = trace[t]
        d = above[t] + carried
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * 2 * z * (1 - z)  # z = (1 + tanh u) / 2, so dz/du = 2 z (1 - z)
        d_r = d_n * g[:, 2 * UNITS :] * 2 * r * (1 - r)
        d_g = np.concatenate([d_r, d_z, d_n * r], 1)
        d_inputs[t] = np.concatenate([d_r, d_z, d_n], 1)
        d_loop += h.T @ d_g
        carried = d * z + d_g @ loop.T
    order = np.argsort(x, axis=None, kind="stable")
    seen = x.ravel()[order]
    firsts = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]])
    d_table = np.zeros((256, 3 * UNITS), np.float32)
    d_table[seen[firsts]] = np.add.reduceat(d_inputs.reshape(-1, 3 * UNITS)[order], firsts)
    return d_table, d_loop


def gradients(net: Network, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients; ``x``: positions x lessons of bytes."""
    traces = [_run(net.tables[0], net.loops[0], x), _run(net.tables[1], net.loops[1], x[::-1])]
    states = [np.stack([t[-1] for t in traces[0]]), np.stack([t[-1] for t in traces[1]])[::-1]]
    p = _softmax(states[0] @ net.outs[0] + states[1] @ net.outs[1] + net.bias)
    columns = np.arange(x.shape[1])
    loss = float(-np.log(np.maximum(p[:, columns, label], 1e-9)).mean())
    p[:, columns, label] -= 1
    p /= x.size
    d_outs = [np.einsum("tbh,tbc->hc", s, p, optimize=True) for s in states]
    above = [p @ w.T for w in net.outs]
    fwd = _back(net.loops[0], x, traces[0], above[0])
    bwd = _back(net.loops[1], x[::-1], traces[1], above[1][::-1])
    return loss, [fwd[0], bwd[0], fwd[1], bwd[1], *d_outs, p.sum((0, 1))]


def train(lessons: np.ndarray, label: np.ndarray, labels: list[str], steps: int = 160, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam over batches drawn evenly from the labels. ``lessons``: rows of LESSON bytes."""
    net, rng = start(labels, seed), np.random.default_rng(seed)
    members = [np.flatnonzero(label == c) for c in range(len(labels))]
    one, two = ([np.zeros_like(p) for p in net.parameters()] for _ in "12")
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(m, -(-batch // len(labels))) for m in members])
        _, grads = gradients(net, np.ascontiguousarray(lessons[chosen].T), label[chosen])
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), grads, one, two, strict=True):
            g = g / norm
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def label_positions(net: Network, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over each window's positions of the labels' probabilities; windows are sorted, longest first."""
    steps, count = x.shape
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # windows longer than t
    buffer = np.empty((count, 3 * UNITS), np.float32)
    states = np.zeros((steps, count, UNITS), np.float32)
    h = np.zeros((count, UNITS), np.float32)
    for t in range(steps):
        if not (n := active[t]):
            break
        a = np.take(net.tables[0], x[t, :n], axis=0, out=buffer[:n], mode="clip")
        h[:n] = states[t, :n] = _gates(a, h[:n] @ net.loops[0], h[:n])[0]
    h[:] = 0
    sums = np.zeros((count, len(net.labels)), np.float32)
    for t in range(steps - 1, -1, -1):
        if not (n := active[t]):
            continue
        a = np.take(net.tables[1], x[t, :n], axis=0, out=buffer[:n], mode="clip")
        h[:n] = _gates(a, h[:n] @ net.loops[1], h[:n])[0]
        sums[:n] += _softmax(states[t, :n] @ net.outs[0] + h[:n] @ net.outs[1] + net.bias)
    return sums


def windows_of(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of the windows that cover each row."""
    n = np.diff(offsets)
    count = -(-n // size)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[row] + nth * size, np.minimum(size, n[row] - nth * size), row


def probabilities(net: Network, texts: pa.Array, at_once: int = 4096) -> np.ndarray:
    """Of each text, the mean over all its bytes of the labels' probabilities; 0 for empty texts."""
    data, offsets = flat(texts)
    begin, length, row = windows_of(offsets, WINDOW)
    order = np.argsort(-length, kind="stable")
    total = np.zeros((len(texts), len(net.labels)))
    for i in range(0, len(order), at_once):
        part = order[i : i + at_once]
        at = begin[part] + np.arange(WINDOW)[:, None]
        x = data[np.minimum(at, len(data) - 1)]
        sums = label_positions(net, x, length[part])
        for c in range(sums.shape[1]):
            total[:, c] += np.bincount(row[part], weights=sums[:, c], minlength=len(texts))
    return total / np.maximum(1, np.diff(offsets))[:, None]


def lessons(docs: DataFrame, per_label: int, doc_id: str, text: str, lang: str) -> DataFrame:
    """(lang, lesson): the whole texts of training rows with a letter, in pieces of LESSON bytes.

    About ``per_label`` rows of each label are taken by a hash of id and text, and equal rows of one id
    count once, so what is collected is bounded by rows whatever the input. The last piece ends where
    the text does; a text shorter than a piece is repeated to fill it.
    """
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return known.select("lang", F.lit(b"").alias("lesson")).limit(0)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(per_label / r["n"]))])
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 30)).dropDuplicates(["doc_id", "text", "lang"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"lang": [], "lesson": []}
            for t, l in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                raw = t.encode()
                if LETTER.search(t):
                    for at in [*range(0, len(raw) - LESSON, LESSON), max(0, len(raw) - LESSON)]:
                        piece = raw[at : at + LESSON]
                        out["lang"].append(l)
                        out["lesson"].append((piece * (-(-LESSON // len(piece))))[:LESSON])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("lesson", pa.binary())]))

    return mapped(drawn.select("text", "lang"), cut, "lang string, lesson binary")


def fit(docs: DataFrame, per_label: int = 400, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Train on rows whose crc32(doc_id as text) is no multiple of 5; None if none has a label and a letter.

    The bound of the sample is ``per_label`` rows of each label, of which all bytes are lessons.
    """
    rows = sorted((r["lang"], bytes(r["lesson"])) for r in lessons(docs, per_label, doc_id, text, lang).collect())
    if not rows:
        return None
    labels = sorted({l for l, _ in rows})
    data = np.frombuffer(b"".join(x for _, x in rows), np.uint8).reshape(-1, LESSON)
    return train(data, np.array([labels.index(l) for l, _ in rows]), labels)


def identify(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row's whole text: every byte is labelled, and the labels are pooled.

    Null texts and those without a letter are "und" with score 0, as is everything without a network.
    Rows stay where they are; other columns are not used or returned.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            lettered = np.array([t is not None and LETTER.search(t) is not None for t in texts]) & (net is not None)
            p = probabilities(net, batch.column("text")) if net is not None else np.zeros((len(texts), 1))
            best = p.argmax(1)
            score = np.where(lettered, np.clip(p.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([net.labels[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return mapped(named, run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    found = identify(docs, fit(docs, doc_id=doc_id, text=text, lang=lang), doc_id, text)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
