"""Progressive JPEG in numpy: many files coded and decoded side by side.

Coefficients lie in one array of blocks (64 in zigzag order) for all files of a batch. A scan of a file
is cut into restart intervals, which don't depend on each other; the Huffman decoder steps through all
intervals of all files at once, a code in each step.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from .arrow import gather

#: Blocks of a scan between two restart markers; of an interleaved scan, units of 6 blocks.
INTERVAL = 4
SAMPLING = ((2, 2), (1, 1), (1, 1))
BLOCKS_A_UNIT = (4, 1, 1)


@dataclass(frozen=True)
class Scan:
    """One pass over the coefficients: components, first and last coefficient, bits already known and still below."""

    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int


#: Spectral selection (DC, then low and high frequencies of Y) and successive approximation (all but the last bit, then that).
SCRIPT = (
    Scan((0, 1, 2), 0, 0, 0, 1),
    Scan((0,), 1, 5, 0, 1),
    Scan((1,), 1, 63, 0, 1),
    Scan((2,), 1, 63, 0, 1),
    Scan((0,), 6, 63, 0, 1),
    Scan((0, 1, 2), 0, 0, 1, 0),
    *(Scan((c,), 1, 63, 1, 0) for c in range(3)),
)


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: along the diagonals, in turn up and down."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def code_lengths() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(symbol, bits) of the DC and the AC code: 4 bits for the end of a block and values after no zero, 9 for others."""
    dc = [(s, 4) for s in range(12)]
    short = [0x00, *range(0x01, 0x09)]
    rest = [r << 4 | s for r in range(16) for s in range(11) if r << 4 | s not in short]
    return dc, [(s, 4) for s in short] + [(s, 9) for s in rest]


def canonical(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, bits): codes count up, and double with each further bit."""
    out, code, was = {}, 0, 0
    for symbol, bits in sorted(lengths, key=lambda x: x[1]):
        code <<= bits - was
        out[symbol], code, was = (code, bits), code + 1, bits
    return out


def _table(lengths: list[tuple[int, int]], kind: int) -> bytes:
    counts = [sum(b == n for _, b in lengths) for n in range(1, 17)]
    return bytes([kind, *counts, *(s for s, _ in sorted(lengths, key=lambda x: x[1]))])


DC, AC = code_lengths()
ZIGZAG = zigzag()


def _arrays(lengths: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    codes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, b) in canonical(lengths).items():
        codes[s], bits[s] = c, b
    return codes, bits


DC_CODE, AC_CODE = _arrays(DC), _arrays(AC)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def units_of(blocks: int) -> tuple[int, int]:
    """Width and height, in units of 16 x 16 pixels, of a picture that holds so many blocks."""
    units = max(1, -(-blocks // 6))
    width = max(1, min(units, int(units**0.5)), -(-units // 4095))
    return width, -(-units // width)


BITS_OF = np.array([n.bit_length() for n in range(1 << 12)])


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of each absolute value."""
    return BITS_OF[np.abs(values)]


def _or_into(words: np.ndarray, at: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
    """Set the ``bits`` (up to 64) of each value from bit ``at`` on, which rises; bit 0 is the first word's highest."""
    if not len(at):
        return
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    left = value << (64 - bits).astype(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] |= np.bitwise_or.reduceat(left >> shift, first)
    last = np.r_[first[1:] - 1, len(at) - 1]  # only these reach into the next word
    words[word[last] + 1] |= left[last] << (np.uint64(64) - shift[last])


class _Bits:
    """Collects the coded items of blocks and packs them by row (restart interval), padded with ones to whole bytes.

    The items of a block come either by add_blocks(), as many for each of the blocks, or by add().
    """

    def __init__(self, row: np.ndarray):
        self.row = row  # of each block
        self.dense: list[tuple[np.ndarray, ...]] = []
        self.sparse: list[tuple[np.ndarray, ...]] = []

    def add(self, block: np.ndarray, order: np.ndarray, values: np.ndarray, bits: np.ndarray) -> None:
        """Items in any order; ``order`` tells it for all of them."""
        self.sparse.append(tuple(np.broadcast_to(x, np.shape(block)).astype(np.int64) for x in (block, order, values, bits)))

    def add_blocks(self, block: np.ndarray, values: np.ndarray, bits: np.ndarray) -> None:
        """A line of items for each of the (rising) blocks."""
        self.dense.append((block, values.astype(np.uint64), bits.astype(np.int64)))

    def packed(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets), without the zeros that are stuffed after 0xFF."""
        size = np.zeros(len(self.row), np.int64)
        items = []
        for block, values, bits in self.dense:
            ends = np.cumsum(bits, 1)
            size[block] = ends[:, -1]
            items.append((block[:, None], ends - bits, values, bits))
        if self.sparse:
            block, order, values, bits = (np.concatenate(x) for x in zip(*self.sparse, strict=True))
            by = np.argsort(order, kind="stable")
            block, values, bits = block[by], values[by].astype(np.uint64), bits[by]
            own = np.bincount(block, weights=bits, minlength=len(size)).astype(np.int64)
            size += own
            items.append((block, np.cumsum(bits) - bits - (np.cumsum(own) - own)[block], values, bits))
        total = np.bincount(self.row, weights=size, minlength=rows).astype(np.int64)
        pad = -total % 8
        whole = (total + pad) // 8
        edges = np.r_[0, np.cumsum(whole)]
        begins = edges[:-1] * 8
        at = np.cumsum(size) - size + (begins - (np.cumsum(total) - total))[self.row]
        words = np.zeros(int(edges[-1]) // 8 + 2, np.uint64)
        for block, inside, values, bits in items:
            _or_into(words, (at[block] + inside).ravel(), values.ravel(), bits.ravel())
        _or_into(words, begins + total, ((1 << pad) - 1).astype(np.uint64), pad)
        return words.astype(">u8").view(np.uint8)[: int(edges[-1])], edges


@functools.cache
def _codes(low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code and bits of each payload byte that is not zero without its ``low`` last bits, alone and (65,536) with the next."""
    value = np.arange(256) - 128
    value = np.sign(value) * (np.abs(value) >> low)
    size = _sizes(value)
    code, bits = (AC_CODE[0][size] << size) | np.where(value < 0, value + (1 << size) - 1, value), AC_CODE[1][size] + size
    return code, bits, ((code[None, :] << bits[:, None]) | code[:, None]).ravel(), (bits[None, :] + bits[:, None]).ravel()


def _dense_first_ac(band: np.ndarray, block: np.ndarray, scan: Scan, out: _Bits) -> None:
    """Blocks of payload bytes in which no value is zero: a code each, four of them an item (44 bits at most)."""
    code, bits, pair_code, pair_bits = _codes(scan.low)
    n, width = band.shape
    pairs = width // 2
    codes, sizes = np.zeros((n, -(-width // 4) * 2), np.uint64), np.zeros((n, -(-width // 4) * 2), np.uint8)
    two = np.ascontiguousarray(band[:, : 2 * pairs]).view("<u2")
    codes[:, :pairs], sizes[:, :pairs] = pair_code[two], pair_bits[two]
    if width % 2:
        codes[:, pairs], sizes[:, pairs] = code[band[:, -1]], bits[band[:, -1]]
    out.add_blocks(block, codes[:, ::2] << sizes[:, 1::2] | codes[:, 1::2], sizes[:, ::2] + sizes[:, 1::2])


def _dense_refine_ac(band: np.ndarray, block: np.ndarray, scan: Scan, out: _Bits) -> None:
    """Blocks of payload bytes in which every value is known: the end of the block, then a correction bit each."""
    n, width = band.shape
    wide = np.zeros((n, 64), np.uint8)
    wide[:, 64 - width :] = band & 1  # the last bit of byte - 128 and of its absolute value, which a second pass adds
    values = np.full((n, 2), AC_CODE[0][0], np.uint64)
    values[:, 1] = np.packbits(wide, axis=1).view(">u8")[:, 0]
    out.add_blocks(block, values, np.broadcast_to(np.array([AC_CODE[1][0], width]), (n, 2)))


def _first_dc(value: np.ndarray, fresh: np.ndarray, scan: Scan, out: _Bits) -> None:
    """``value``: of the blocks in scan order; ``fresh``: place among them of the last block of the component, or -1."""
    value = value >> scan.low
    diff = value - np.where(fresh >= 0, value[fresh], 0)
    size = _sizes(diff)
    code = (DC_CODE[0][size] << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    out.add_blocks(np.arange(len(value)), code[:, None], (DC_CODE[1][size] + size)[:, None])


def _first_ac(band: np.ndarray, row: np.ndarray, scan: Scan, out: _Bits) -> None:
    """``band``: values of blocks; ``row``: the blocks' numbers for ``out``."""
    band = np.sign(band) * (np.abs(band) >> scan.low)
    width = band.shape[1]
    block, k = np.nonzero(band)
    value = band[block, k]
    new = np.r_[True, block[1:] != block[:-1]] if len(block) else np.zeros(0, bool)
    run = k - np.where(new, -1, np.r_[0, k[:-1]] if len(k) else k) - 1
    zeros, run16 = run & 15, run >> 4
    size = _sizes(value)
    symbol = zeros << 4 | size
    place = (block * (width + 1) + k) * 2
    out.add(row[block], place + 1, (AC_CODE[0][symbol] << size) | np.where(value < 0, value + (1 << size) - 1, value), AC_CODE[1][symbol] + size)
    for n in range(1, int(run16.max(initial=0)) + 1):
        long = run16 >= n
        out.add(row[block[long]], place[long], AC_CODE[0][0xF0], AC_CODE[1][0xF0])
    last = np.full(len(band), -1)
    last[block] = k  # the largest k is written last
    short = np.flatnonzero(last < width - 1)
    out.add(row[short], (short * (width + 1) + width) * 2, AC_CODE[0][0], AC_CODE[1][0])


def _refine_ac(band: np.ndarray, row: np.ndarray, scan: Scan, out: _Bits) -> None:
    """``band``: values of blocks; ``row``: the blocks' numbers for ``out``."""
    size, width = np.abs(band) >> scan.low, band.shape[1]
    old, new = size > 1, size == 1
    # A symbol stands before each new value, before the sixteenth zero of a longer run, and at the end of a
    # block for what is left; after it come the correction bits of the known values up to its place.
    zero = ~old
    nth_zero = np.cumsum(zero, 1)  # zeros (old value unknown) up to here
    last_new = np.where(new.any(1), width - 1 - np.argmax(new[:, ::-1], 1), -1)
    block, k = np.nonzero(new)
    before = np.r_[0, nth_zero[block, k][:-1]] if len(block) else nth_zero[block, k]
    first = np.r_[True, block[1:] != block[:-1]] if len(block) else np.zeros(0, bool)
    run = nth_zero[block, k] - 1 - np.where(first, 0, before)
    symbol = (run & 15) << 4 | 1
    sign = (band[block, k] > 0).astype(np.int64)
    # Where each symbol begins: after the place of the one before it in the block.
    begin = np.where(first, 0, np.r_[0, k[:-1] + 1] if len(k) else k)
    step = 4 * (width + 1)
    runs16 = run >> 4
    start_of = begin.copy()
    for n in range(1, int(runs16.max(initial=0)) + 1):
        long = np.flatnonzero(runs16 >= n)
        out.add(row[block[long]], block[long] * step + start_of[long] * 4, AC_CODE[0][0xF0], AC_CODE[1][0xF0])
        target = np.where(first[long], 0, before[long]) + 16 * n
        start_of[long] = (nth_zero[block[long]] < target[:, None]).sum(1) + 1
    out.add(row[block], block * step + start_of * 4 + 1, AC_CODE[0][symbol] << 1 | sign, AC_CODE[1][symbol] + 1)
    rest = np.flatnonzero(last_new < width - 1)
    out.add(row[rest], rest * step + (last_new[rest] + 1) * 4 + 1, AC_CODE[0][0], AC_CODE[1][0])
    block, k = np.nonzero(old)
    out.add(row[block], block * step + k * 4 + 2, size[block, k] & 1, np.ones(len(block)))


def _layout(widths: np.ndarray, heights: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Of each component: the first block of each file."""
    units = widths * heights
    return [starts, starts + 4 * units, starts + 5 * units]


def _unit_order(width: int, height: int) -> np.ndarray:
    """Blocks of a file (Y by rows, then Cb, then Cr) in the order of an interleaved scan."""
    y, x = np.divmod(np.arange(width * height), width)
    luma = [(2 * y + v) * 2 * width + 2 * x + h for v in (0, 1) for h in (0, 1)]
    units = width * height
    return np.stack([*luma, 4 * units + np.arange(units), 5 * units + np.arange(units)], 1).ravel()


def encode(payloads: np.ndarray, blocks: np.ndarray) -> list[bytes]:
    """Files that hold the payload bytes as quantised coefficients, byte minus 128 in zigzag order.

    ``payloads``: the blocks of 64 bytes of all files; ``blocks``: how many each file has. The blocks
    fill Y by rows, then Cb, then Cr; a comment says how many they are.
    """
    shapes = [units_of(int(b)) for b in blocks]
    widths, heights = (np.array(x) for x in zip(*shapes, strict=True))
    each = 6 * widths * heights
    starts = np.cumsum(each) - each
    stored = np.full((int(each.sum()), 64), 128, np.uint8)
    stored[gather(np.arange(len(stored)), starts, blocks)] = payloads.reshape(-1, 64)
    # Blocks without values from -1 to 1 (zero in a first pass, or new in the second) are coded by tables, those of zeros alone are ends.
    small = (np.abs(np.arange(256) - 128) < 2)[stored]
    components = _layout(widths, heights, starts)
    file_of = np.arange(len(blocks))
    orders = {shape: _unit_order(*shape) for shape in set(shapes)}
    mixed = np.concatenate([orders[shape] + s for shape, s in zip(shapes, starts, strict=True)])
    parts: list[list[bytes]] = [[] for _ in blocks]
    for scan in SCRIPT:
        if len(scan.components) > 1:
            count, order, unit = widths * heights, mixed, 6
        else:
            c = scan.components[0]
            count, unit = widths * heights * BLOCKS_A_UNIT[c], 1
            order = gather(np.arange(len(stored)), components[c], count)
        intervals = -(-count // INTERVAL)
        base = np.cumsum(intervals) - intervals
        owner = np.repeat(file_of, count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        row = np.repeat(base[owner] + nth // INTERVAL, unit)
        bits = _Bits(row)
        if scan.first == 0:
            value = stored[order, 0].astype(np.int64) - 128
            if scan.high == 0:
                at = np.arange(len(order))
                inside = at % 6
                back = np.where(inside == 0, 3, np.where(inside < 4, 1, 6))  # to the last block of the component
                fresh = at - back
                same = (fresh >= 0) & (row[np.maximum(fresh, 0)] == row)
                _first_dc(value, np.where(same, fresh, -1), scan, bits)
            else:
                bits.add_blocks(np.arange(len(order)), (value >> scan.low & 1)[:, None], np.ones((len(order), 1)))
        else:
            band = stored[order, scan.first : scan.last + 1]
            hard = small[order, scan.first : scan.last + 1].any(1)
            empty = np.zeros(len(order), bool)
            empty[hard] = (band[hard] == 128).all(1)
            hard &= ~empty
            ends, dense, rest = np.flatnonzero(empty), np.flatnonzero(~hard & ~empty), np.flatnonzero(hard)
            bits.add_blocks(ends, np.full((len(ends), 1), AC_CODE[0][0]), np.full((len(ends), 1), AC_CODE[1][0]))
            (_dense_refine_ac if scan.high else _dense_first_ac)(band if len(dense) == len(band) else band[dense], dense, scan, bits)
            if len(rest):
                (_refine_ac if scan.high else _first_ac)(band[rest].astype(np.int32) - 128, rest, scan, bits)
        data, offsets = bits.packed(int(intervals.sum()))
        # A 0 is stuffed after 0xFF, and markers RST0 to RST7 stand between the intervals of a file.
        rows_owner = np.repeat(file_of, intervals)
        index = np.arange(len(rows_owner)) - base[rows_owner]
        between = index < intervals[rows_owner] - 1
        stuffed, marks = np.flatnonzero(data == 0xFF) + 1, offsets[1:][between]
        marker = np.stack([np.full(len(marks), 0xFF), 0xD0 + index[between] % 8], 1).ravel()
        places = np.r_[stuffed, np.repeat(marks, 2)]
        out = np.insert(data, places, np.r_[np.zeros(len(stuffed), np.int64), marker].astype(np.uint8))
        edges = offsets[np.r_[base, len(rows_owner)]]
        edges = edges + np.searchsorted(np.sort(places), edges, side="right")
        head = _segment(0xDA, bytes([len(scan.components), *(x for c in scan.components for x in (c + 1, 0)), scan.first, scan.last, scan.high << 4 | scan.low]))
        whole = out.tobytes()
        for f in file_of:
            parts[f] += (head, whole[edges[f] : edges[f + 1]])
    tables = _segment(0xDB, bytes([0] + [1] * 64)) + _segment(0xC4, _table(DC, 0x00) + _table(AC, 0x10)) + _segment(0xDD, INTERVAL.to_bytes(2, "big"))
    files = []
    for f, (w, h) in enumerate(shapes):
        frame = bytes([8]) + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        files.append(b"".join([b"\xff\xd8", _segment(0xFE, int(blocks[f]).to_bytes(8, "big")), tables, _segment(0xC2, frame), *parts[f], b"\xff\xd9"]))
    return files


# Decoding


@dataclass
class _File:
    width: int = 0  # in units
    height: int = 0
    blocks: int = 0
    quant: bytes = b""  # in zigzag order
    start: int = 0  # its first block in the batch


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may come next: symbol << 5 | bits of its code; 0 if there is none."""
    out = np.zeros(1 << 16, np.int32)
    code, at = 0, 16
    for bits in range(1, 17) if table else ():
        for _ in range(table[bits - 1]):
            out[code << 16 - bits : code + 1 << 16 - bits] = table[at] << 5 | bits
            code, at = code + 1, at + 1
        code <<= 1
    return out


@functools.lru_cache(8)
def _values(table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_lookup() of an AC table, and for each 16 bits that hold a whole value: its bits in all (else 0), itself, and its run of zeros plus 1."""
    symbols = _lookup(table)
    bits, run, size = symbols & 31, symbols >> 9, symbols >> 5 & 15
    whole = (bits > 0) & (bits + size <= 16) & ((size > 0) | (run == 15))
    raw = np.arange(1 << 16) >> np.maximum(16 - bits - size, 0) & (1 << size) - 1
    return symbols, np.where(whole, bits + size, 0).astype(np.uint8), np.where(whole, _extended(raw, size), 0).astype(np.int16), np.where(whole, run + 1, 1).astype(np.uint8)


class _Lanes:
    """Bit positions in many intervals at once."""

    def __init__(self, window: np.ndarray, at: np.ndarray):
        self.window = window  # the 4 bytes from each byte on
        self.at = at.astype(np.int64)

    def word(self, at: np.ndarray) -> np.ndarray:
        """The 64 bits from each position on."""
        byte, shift = np.minimum(at >> 3, len(self.window) - 9), (at & 7).astype(np.uint64)
        wide = self.window[byte].astype(np.uint64) << np.uint64(32) | self.window[byte + 4]
        return wide << shift | self.window[byte + 8] >> np.uint64(24) >> (np.uint64(8) - shift)

    def peek16(self, at: np.ndarray) -> np.ndarray:
        return self.window[np.minimum(at >> 3, len(self.window) - 9)] >> (16 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)

    def take(self, lanes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The next ``bits`` (0 to 16) of each lane."""
        value = self.peek16(self.at[lanes]).astype(np.int64) >> (16 - bits)
        self.at[lanes] += bits
        return value

    def symbol(self, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
        found = table[self.peek16(self.at[lanes])]
        if (found == 0).any():
            raise ValueError("a code that the table doesn't have")
        self.at[lanes] += found & 31
        return found >> 5


def _extended(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (value < (1 << np.maximum(size, 1) - 1)), value - (1 << size) + 1, value)


def _read_first_ac(scan: Scan, bits: _Lanes, begins: np.ndarray, counts: np.ndarray, coefficients: np.ndarray, table: bytes) -> None:
    """Lane i reads ``counts[i]`` blocks from number ``begins[i]`` on, a value in each step."""
    symbols, total, values, moves = _values(table)
    flat = coefficients.reshape(-1)
    width = scan.last - scan.first + 1
    on = counts > 0
    at, place = bits.at[on], begins[on] * 64 + scan.first
    end = place + width  # of the block's band; ``last`` of the last block's
    last = end + (counts[on] - 1) * 64
    while len(at):
        ahead = bits.peek16(at)
        used, moved = total[ahead], moves[ahead]
        place += moved
        flat[place - 1] = values[ahead] << scan.low
        at += used
        odd = np.flatnonzero(used == 0)
        if len(odd):  # the end of a block or of several, or a long value
            lane = _Lanes(bits.window, at[odd])
            every = np.arange(len(odd))
            symbol = lane.symbol(every, symbols)
            run, size = symbol >> 4, symbol & 15
            place[odd] += run  # 1 is counted already
            value = _extended(lane.take(every, size), size)
            has = size > 0
            flat[place[odd[has]] - 1] = value[has] << scan.low
            ends = ~has & (run < 15)
            run = run[ends]
            end[odd[ends]] += ((1 << run) - 1 + lane.take(every[ends], run)) * 64
            place[odd[ends]] = end[odd[ends]]
            at[odd] = lane.at
        full = place >= end
        if full.any():
            stays = ~full | (end < last)
            place = np.where(full, end + 64 - width, place)
            end = end + 64 * full
            if not stays.all():
                at, place, end, last = at[stays], place[stays], end[stays], last[stays]


def _corrected(band: np.ndarray, bits: np.ndarray, low: int) -> np.ndarray:
    """Values with a bit of 0 or 1 more, away from zero."""
    return band + (((band >> 15) | 1) * bits << low)


def _read_scan(scan: Scan, bits: _Lanes, order: np.ndarray, firsts: np.ndarray, counts: np.ndarray, coefficients: np.ndarray, dc: np.ndarray, ac_table: bytes, ac: np.ndarray) -> None:
    """Add a scan to the coefficients. Lane i reads ``counts[i]`` blocks, order[firsts[i]] and so on; of one component they are neighbours."""
    lanes = np.arange(len(firsts))
    if scan.first == 0:
        kind = np.array([0, 0, 0, 0, 1, 2]) if len(scan.components) > 1 else np.array([scan.components[0]])
        last = np.zeros((len(lanes), 3), np.int64)
        for step in range(int(counts.max(initial=0))):
            on = lanes[counts > step]
            block = order[firsts[on] + step]
            if scan.high:
                coefficients[block, 0] |= bits.take(on, np.int64(1)).astype(np.int16) << scan.low
                continue
            size = bits.symbol(on, dc)
            c = kind[step % len(kind)]
            last[on, c] += _extended(bits.take(on, size), size)
            coefficients[block, 0] = last[on, c] << scan.low
        return
    if scan.high == 0:
        _read_first_ac(scan, bits, order[firsts], counts, coefficients, ac_table)
        return
    done = np.zeros(len(lanes), np.int64)  # blocks read
    skip = np.zeros(len(lanes), np.int64)  # blocks still in a run of ends
    k = np.zeros(len(lanes), np.int64)
    on = lanes[counts > 0]
    width = scan.last - scan.first + 1
    column = np.arange(width)
    while len(on):
        # A symbol, unless the block is in a run of ends.
        fresh = on[skip[on] == 0]
        symbol = np.zeros(len(bits.at), np.int64)
        symbol[fresh] = bits.symbol(fresh, ac)
        run, size = symbol[on] >> 4, symbol[on] & 15
        ends = (skip[on] > 0) | ((size == 0) & (run < 15))
        starting = ends & (skip[on] == 0)
        skip[on[starting]] = (1 << run[starting]) + bits.take(on[starting], run[starting])
        sign = np.zeros(len(on), np.int64)
        sign[size > 0] = bits.take(on[size > 0], np.int64(1))
        block = order[firsts[on] + done[on]]
        band = coefficients[block, scan.first : scan.last + 1]
        known = band != 0
        # Whole blocks of known values have a bit for each.
        whole = ends & (k[on] == 0) & known.all(1)
        simple = np.flatnonzero(whole)
        if len(simple):
            each = bits.word(bits.at[on[simple]]).astype(">u8").view(np.uint8).reshape(-1, 8)
            new_band = _corrected(band[simple], np.unpackbits(each, axis=1, count=width).astype(np.int16), scan.low)
            if len(simple) == len(on):
                band = new_band
            else:
                band[simple] = new_band
            bits.at[on[simple]] += width
        stop = np.full(len(on), width)
        hard = np.flatnonzero(~whole)
        if len(hard):
            these = on[hard]
            part, is_known = band[hard], known[hard]
            ahead = column >= k[these][:, None]
            # The place after which the symbol ends: that of its last zero, or the block's end.
            zeros = np.cumsum(~is_known & ahead, 1, dtype=np.int16)
            stop[hard] = np.where(ends[hard], width, (zeros <= run[hard][:, None]).sum(1))
            correct = is_known & ahead & (column < stop[hard][:, None])
            nth = np.cumsum(correct, 1, dtype=np.int16)
            each = np.unpackbits(bits.word(bits.at[these]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            bit = np.take_along_axis(each, np.maximum(nth - 1, 0).astype(np.int64), 1) * correct
            bits.at[these] += nth[:, -1]
            band[hard] = _corrected(part, bit.astype(np.int16), scan.low)
        new = np.flatnonzero((size > 0) & (stop < width))
        band[new, stop[new]] = np.where(sign[new] == 1, 1, -1) << scan.low
        coefficients[block, scan.first : scan.last + 1] = band
        k[on] = stop + 1
        over = on[ends | (stop + 1 >= width)]
        skip[on[ends]] -= 1
        done[over] += 1
        k[over] = 0
        on = on[done[on] < counts[on]]


def decode(files: list[bytes]) -> tuple[np.ndarray, list[_File]]:
    """(coefficients of all files, what their headers say).

    Reads progressive files with three components, chroma halved both ways, and restart intervals of
    any length; scans of one number in all files are read together.
    """
    whole = np.frombuffer(b"".join(files), np.uint8)
    offsets = np.r_[0, np.cumsum([len(f) for f in files])].tolist()
    full = np.flatnonzero(whole[:-1] == 0xFF)
    marks = full[(whole[full + 1] != 0) & (whole[full + 1] != 0xFF)]
    stops = np.flatnonzero((whole[marks + 1] & 0xF8) != 0xD0)  # of the markers those that end a scan's data
    stop_at = marks[stops].tolist()
    heads: list[_File] = []
    scans: list[dict[tuple, list[tuple]]] = []
    tables_of: dict[bytes, dict[int, bytes]] = {}
    blocks = p = 0
    for f, text in enumerate(files):
        head, base, at, interval, tables, nth = _File(), offsets[f], 2, 0, {}, 0
        while text[at + 1] != 0xD9:
            marker, size = text[at + 1], text[at + 2] << 8 | text[at + 3]
            body = text[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDA:
                n = body[0]
                key = (body, tables.get(0x00, b""), tables.get(0x10, b""))
                while stop_at[p] < base + at:
                    p += 1
                if len(scans) <= nth:
                    scans.append({})
                scans[nth].setdefault(key, []).append((f, interval, base + at, p))
                nth, at = nth + 1, stop_at[p] - base
            elif marker == 0xFE and len(body) == 8:
                head.blocks = int.from_bytes(body, "big")
            elif marker == 0xDB:
                head.quant = body[1:65]
            elif marker == 0xDD:
                interval = body[0] << 8 | body[1]
            elif marker == 0xC4:
                if body not in tables_of:
                    i, found = 0, {}
                    while i < len(body):
                        n = 17 + sum(body[i + 1 : i + 17])
                        found[body[i]] = body[i + 1 : i + n]
                        i += n
                    tables_of[body] = found
                tables = tables | tables_of[body]
            elif marker == 0xC2:
                head.height, head.width, head.start = (body[1] << 8 | body[2]) // 16, (body[3] << 8 | body[4]) // 16, blocks
                blocks += 6 * head.width * head.height
        heads.append(head)
    coefficients = np.zeros((blocks, 64), np.int16)
    # A 0 after 0xFF is stuffing, which is left out of what the scans read.
    stuffing = full[whole[full + 1] == 0] + 1
    kept = np.ones(len(whole), bool)
    kept[stuffing] = False
    read = np.r_[whole[kept], np.full(16, 0xFF, np.uint8)]
    window = np.ndarray(len(read) - 3, ">u4", read, 0, (1,)).astype(np.uint32)
    everything = np.arange(blocks)
    shapes = np.array([(h.width, h.height, h.start) for h in heads])
    orders: dict[tuple[int, int], np.ndarray] = {}
    lookups: dict[bytes, np.ndarray] = {}
    for together in scans:
        for (body, dc, ac), entries in together.items():
            n = body[0]
            scan = Scan(tuple(body[1 + 2 * i] - 1 for i in range(n)), body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15)
            file, interval, first_at, stop = np.array(entries).T
            units = shapes[file, 0] * shapes[file, 1]
            if n > 1:
                unit, size = 6, 6 * units
                for w, h in {(h.width, h.height) for h in (heads[i] for i in file)}.difference(orders):
                    orders[w, h] = _unit_order(w, h)
                order = np.concatenate([orders[heads[i].width, heads[i].height] + heads[i].start for i in file])
            else:
                c = scan.components[0]
                unit, size = 1, BLOCKS_A_UNIT[c] * units
                order = gather(everything, shapes[file, 2] + (0, 4, 5)[c] * units, size)
            step = np.where(interval > 0, interval * unit, size)
            lanes = -(-size // step)
            nth_lane = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            firsts = np.repeat(np.cumsum(size) - size, lanes) + nth_lane * np.repeat(step, lanes)
            counts = np.minimum(np.repeat(step, lanes), np.repeat(size, lanes) - nth_lane * np.repeat(step, lanes))
            # Each lane ends at a marker; the next one begins after it.
            end = gather(marks, stops[stop] - lanes + 1, lanes)
            begin = np.r_[0, end[:-1] + 2]
            begin[nth_lane == 0] = first_at
            starts = begin - np.searchsorted(stuffing, begin)
            for t in (dc, ac):
                if t not in lookups:
                    lookups[t] = _lookup(t)
            _read_scan(scan, _Lanes(window, starts * 8), order, firsts, counts, coefficients, lookups[dc], ac, lookups[ac])
    return coefficients, heads


def payload(coefficients: np.ndarray, head: _File) -> bytes:
    """The bytes that encode() stored."""
    return (coefficients[head.start : head.start + head.blocks] + 128).astype(np.uint8).tobytes()


def _basis() -> np.ndarray:
    """Inverse transform of a block as a 64 x 64 matrix of whole numbers, scaled by 2^16; from zigzag order to rows.

    Sums of products with it stay below 2^53, so float64 has them exactly and in any order.
    """
    n = np.arange(8)
    one = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) / 2
    one[0] = np.sqrt(1 / 8)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG] * (1 << 16))


BASIS = _basis()


def samples(coefficients: np.ndarray, heads: list[_File]) -> np.ndarray:
    """The 64 samples of each block, by rows."""
    if any(h.quant != bytes([1]) * 64 for h in heads):
        steps = np.stack([np.frombuffer(h.quant, np.uint8) for h in heads])
        coefficients = coefficients.astype(np.int32) * np.repeat(steps, [6 * h.width * h.height for h in heads], 0)
    out = coefficients.astype(np.float64) @ BASIS
    out += (128 << 16) + (1 << 15)
    np.clip(out, 0, (256 << 16) - 1, out=out)
    return (out.astype(np.int32) >> 16).astype(np.int16)


def rgb(blocks: np.ndarray, head: _File) -> np.ndarray:
    """The picture at full resolution from the samples of its batch: height x width x 3, 8 bits."""
    units, w, h = head.width * head.height, head.width, head.height
    own = blocks[head.start : head.start + 6 * units]
    out = np.empty((16 * h, 16 * w, 3), np.uint8)
    y = own[: 4 * units].reshape(2 * h, 2 * w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 2, 8 * w, 2)
    chroma = own[4 * units :].reshape(2, h, w, 8, 8).transpose(0, 1, 3, 2, 4).reshape(2, 8 * h, 1, 8 * w, 1)
    # Full-range YCbCr to RGB, factors scaled by 2^16; each chroma sample serves 2 x 2 pixels.
    cb, cr = chroma.astype(np.int32) - 128
    wide = out.reshape(8 * h, 2, 8 * w, 2, 3)
    for c, change in enumerate((91881 * cr + 32768 >> 16, -(22554 * cb + 46802 * cr + 32768 >> 16), 116130 * cb + 32768 >> 16)):
        wide[..., c] = np.clip(y + change.astype(np.int16), 0, 255)
    return out
