import hashlib
import zlib

import numpy as np
import pytest

from parlance.llm import jpeg, media


def padded(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


@pytest.mark.parametrize("choices", [range(256), [126, 127, 128, 129, 130], [128] * 40 + [0, 255], [0]])
def test_round_trip(choices):
    rng = np.random.default_rng(1)
    blocks = rng.integers(1, 40, 12)
    data = rng.choice(list(choices), 64 * int(blocks.sum())).astype(np.uint8)
    coefficients, heads = jpeg.decode(jpeg.encode(data, blocks))
    assert b"".join(jpeg.payload(coefficients, h) for h in heads) == data.tobytes()


class Bits:
    """Bits of one interval, one at a time."""

    def __init__(self, data):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff"), 0

    def take(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | self.data[self.at >> 3] >> 7 - (self.at & 7) & 1
            self.at += 1
        return out

    def symbol(self, codes):
        code, n = 0, 0
        while (code, n) not in codes:
            code, n = code << 1 | self.take(1), n + 1
        return codes[code, n]


def plain_decode(text):
    """Coefficients of a file read bit by bit, as the standard describes its scans."""
    at, codes, interval = 2, {}, 0
    while text[at + 1] != 0xD9:
        marker, size = text[at + 1], int.from_bytes(text[at + 2 : at + 4], "big")
        body, at = text[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            i = 0
            while i < len(body):
                kind, counts = body[i], body[i + 1 : i + 17]
                code, j, table = 0, i + 17, {}
                for bits, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[code, bits] = body[j]
                        code, j = code + 1, j + 1
                    code <<= 1
                codes[kind], i = table, j
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC2:
            h, w = int.from_bytes(body[1:3], "big") // 16, int.from_bytes(body[3:5], "big") // 16
            out = np.zeros((6 * h * w, 64), int)
        elif marker == 0xDA:
            n = body[0]
            comps = [body[1 + 2 * i] - 1 for i in range(n)]
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            parts, begin = [], at
            while True:
                at = text.index(b"\xff", at)
                if text[at + 1] == 0:
                    at += 2
                elif text[at + 1] & 0xF8 == 0xD0:
                    parts.append(text[begin:at])
                    begin = at = at + 2
                else:
                    parts.append(text[begin:at])
                    break
            if n > 1:
                units = [[((2 * y + v) * 2 * w + 2 * x + u, 0) for v in (0, 1) for u in (0, 1)] + [(4 * h * w + y * w + x, 1), (5 * h * w + y * w + x, 2)] for y in range(h) for x in range(w)]
            else:
                units = [[(i + (0, 4, 5)[comps[0]] * h * w, comps[0])] for i in range((4, 1, 1)[comps[0]] * h * w)]
            for p, data in enumerate(parts):
                bits, was, run = Bits(data + b"\xff" * 4), [0, 0, 0], 0
                for block, c in [b for u in units[p * interval : (p + 1) * interval] for b in u]:
                    z = out[block]
                    if first == 0:
                        if high:
                            z[0] |= bits.take(1) << low
                        else:
                            s = bits.symbol(codes[0])
                            v = bits.take(s)
                            was[c] += v if not s or v >= 1 << s - 1 else v - (1 << s) + 1
                            z[0] = was[c] << low
                        continue
                    k = first
                    if run == 0:
                        while k <= last:
                            rs = bits.symbol(codes[0x10])
                            r, s = rs >> 4, rs & 15
                            if s == 0 and r < 15:
                                run = (1 << r) + bits.take(r)
                                break
                            if not high:
                                k += r
                                if s:
                                    v = bits.take(s)
                                    z[k] = (v if v >= 1 << s - 1 else v - (1 << s) + 1) * (1 << low)
                                k += 1
                                continue
                            new = (1 if bits.take(1) else -1) if s else 0
                            while k <= last:
                                if z[k]:
                                    if bits.take(1):
                                        z[k] += np.sign(z[k]) << low
                                elif r == 0:
                                    z[k] = new << low if new > 0 else -(-new << low)
                                    k += 1
                                    break
                                else:
                                    r -= 1
                                k += 1
                    if run:
                        if high:
                            for k in range(k, last + 1):
                                if z[k] and bits.take(1):
                                    z[k] += np.sign(z[k]) << low
                        run -= 1
    return out


@pytest.mark.parametrize("choices", [range(256), [126, 127, 128, 129, 130], [128] * 40 + [0, 255]])
def test_against_a_plain_decoder(choices):
    data = np.random.default_rng(2).choice(list(choices), 64 * 31).astype(np.uint8)
    files = jpeg.encode(data, np.array([31]))
    coefficients, _ = jpeg.decode(files)
    assert (plain_decode(files[0]) == coefficients).all()


@pytest.mark.parametrize("scan", [s for s in jpeg.SCRIPT if s.last])
def test_tables_code_as_the_rules_do(scan):
    """Blocks coded by tables have the bits that run lengths and correction bits give them one by one."""
    data = np.random.default_rng(4).choice([0, 9, 32, 97, 126, 130, 195, 255], (24, scan.last - scan.first + 1)).astype(np.uint8)
    row, block = np.arange(24) // 4, np.arange(24)
    fast, plain = jpeg._Bits(row), jpeg._Bits(row)
    (jpeg._dense_refine_ac if scan.high else jpeg._dense_first_ac)(data, block, scan, fast)
    (jpeg._refine_ac if scan.high else jpeg._first_ac)(data.astype(np.int32) - 128, block, scan, plain)
    for got, want in zip(fast.packed(6), plain.packed(6), strict=True):
        assert got.tolist() == want.tolist()


def test_text_beside_hard_blocks():
    """Texts in several scripts, zeros and 0xFF in one batch: coded by tables and by rules side by side."""
    texts = [b"A plain line of text. " * 40, "日本語の文 é".encode() * 60, bytes(300), b"\xff\x7f\x80\x81" * 90, b"x", b"z" * 63 + b"\x80" + b"y" * 200]
    blocks = np.array([-(-len(t) // 64) for t in texts])
    data = b"".join(t + bytes(-len(t) % 64) for t in texts)
    files = jpeg.encode(np.frombuffer(data, np.uint8), blocks)
    coefficients, heads = jpeg.decode(files)
    assert b"".join(jpeg.payload(coefficients, h) for h in heads) == data
    for f, h in zip(files, heads, strict=True):
        assert (plain_decode(f) == coefficients[h.start : h.start + 6 * h.width * h.height]).all()


def test_work_a_byte(monkeypatch):
    """Text is packed in fewer than half as many items as it has bytes (before: two for each byte), and read without a peek a symbol and value."""
    items, peeks = [], []
    put, peek = jpeg._or_into, jpeg._Lanes.peek16
    monkeypatch.setattr(jpeg, "_or_into", lambda words, at, value, bits: (items.append(len(at)), put(words, at, value, bits)))
    monkeypatch.setattr(jpeg._Lanes, "peek16", lambda self, at: (peeks.append(len(at)), peek(self, at))[1])
    data = np.frombuffer((b"What was said in the meeting, line by line. " * 3000)[: 64 * 1500], np.uint8)
    coefficients, heads = jpeg.decode(jpeg.encode(data, np.array([1500])))
    assert jpeg.payload(coefficients, heads[0]) == data.tobytes()
    assert sum(items) < len(data) / 2 and sum(peeks) < 1.2 * len(data)


def test_cost(cost):
    """A megabyte of text costs about one sort of a million numbers to write and read; before, some four."""
    data = np.frombuffer((b"What was said in the meeting, line by line. " * 30000)[: 1 << 20], np.uint8)
    assert cost(lambda: jpeg.decode(jpeg.encode(data, np.full(256, 64)))) < 2.2


def test_flat_picture():
    """Only Y's constant term: grey of that level; 8 steps of it are one of a sample."""
    data = np.full(64 * 6, 128, np.uint8)
    data[: 64 * 4 : 64] = 128 + 80
    coefficients, heads = jpeg.decode(jpeg.encode(data, np.array([6])))
    picture = jpeg.rgb(jpeg.samples(coefficients, heads), heads[0])
    assert picture.shape == (16, 16, 3) and (picture == 138).all()


def test_zigzag_begins_and_ends():
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and jpeg.ZIGZAG[-1] == 63 and sorted(jpeg.ZIGZAG) == list(range(64))


def test_odd_rows(odd):
    rows = media.digest(odd).collect()
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    want = sorted(repr((i, len((t or "").encode()), len(padded(t)), hashlib.sha256(padded(t)).hexdigest(), zlib.crc32(padded(t)[-64:]))) for i, t in texts)
    got = sorted({repr((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])) for r in rows})
    assert got == want and len(rows) == odd.count()
    same = {r["doc_id"]: (r["media_sha256"], r["feature"]) for r in rows}
    assert same[1] == same[2] and same[5] == same[None]


def test_empty(empty):
    assert media.digest(empty).count() == 0
