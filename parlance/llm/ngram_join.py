"""Jaccard self-join on word n-grams, with prefixes under several global orders as filters.

If two sets A and B have a Jaccard similarity of t or more, then under any one order of all shingles
the first |A| - ceil(t|A|) + 1 shingles of A and the first |B| - ceil(t|B|) + 1 of B have one in
common. The first order here is by rarity, with the shingles of a quarter of all hashes before the
others: texts whose first shingles nobody else has are out at once. The second is by rarity among the
texts that are left, over all their shingles. Further orders are by keyed hashes, and each class of
texts carries its prefixes under them. Pairs that share a prefix shingle by rarity are joined with both
sides' prefixes, and only those that share one under every order have their sets fetched and verified.

Texts with the same set of shingles are one class from the start, and only links that can join two
components are looked for: each class is compared with one pivot for each of its prefix shingles, and
after that only with classes of other components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import binary, flat, lean, lean_table, mapped, pieces
from .common import written
from .components import components
from .shingles import mix, set_keys, shingle_sets

#: Shingles with a hash in the lowest quarter are counted first; they come first in the order by rarity.
COUNTED, ALL = 1 << 62, 1 << 64
#: From this many texts on, shingles are equally frequent.
FREQUENT = 64
#: Seeds of the further orders.
ORDERS = (0x51ED270B, 0x2545F491, 0x6C62272E)
#: Pairs of a shingle and a text that a bucket of hashes gets on average, and how many a task holds before it sums them.
PAIRS_A_BUCKET, HELD = 250_000, 1_000_000
#: Classes to a block, and shingles of all its classes together (a larger class is a block of its own).
BLOCK, BLOCK_SHINGLES = 256, 500_000
#: Bytes of text that a task looks at together: some 50 times that in memory.
PIECE = 1 << 19
#: Bits of the sieve for each id, and the most it may have: 16 megabytes, for 8 million ids. With more ids texts are chosen by a join.
SIEVE_BITS_AN_ID, MOST_SIEVE_BITS = 16, 1 << 27


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of n are its prefix: n - ceil(t n) + 1; 0 for n = 0."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _sends_all(n: np.ndarray, counted: np.ndarray, percent: int) -> np.ndarray:
    """Sets with too few counted shingles to fill their prefix send all their shingles to be counted."""
    return counted < prefix_length(n, percent)


def profiles(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, counted, key, key2) for each row: size of its set, counted shingles, and both keys of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            values, offsets = shingle_sets(batch.column("text"), k)
            low = np.r_[0, np.cumsum(values < np.uint64(COUNTED))]
            columns = [np.diff(offsets), low[offsets[1:]] - low[offsets[:-1]], set_keys(values, offsets), set_keys(values, offsets, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n", "counted", "key", "key2"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n long, counted long, key long, key2 long")


def _packed(hashes: np.ndarray, keys: np.ndarray) -> bytes:
    """Pairs of a shingle and a set's key, 16 bytes each."""
    return hashes.tobytes() + keys.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 16
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.int64, n, 8 * n)


def _dealt(keys: np.ndarray, values: np.ndarray, offsets: np.ndarray, counted: int, percent: int, buckets: int) -> pa.RecordBatch | None:
    """The counted shingles of a piece with their sets, packed by bucket."""
    n = np.diff(offsets)
    early = values <= np.uint64(counted - 1)
    low = np.r_[0, np.cumsum(early)]
    all_ = _sends_all(n, low[offsets[1:]] - low[offsets[:-1]], percent)
    once = np.zeros(len(n), bool)
    once[np.unique(keys, return_index=True)[1]] = True
    sent = np.repeat(once, n) & (np.repeat(all_, n) | early)
    hashes, owners = values[sent], np.repeat(keys, n)[sent]
    if not len(hashes):
        return None
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], owners[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    count = np.diff(np.r_[starts, len(hashes)])
    hot = np.repeat(count >= FREQUENT, count)
    marks = hashes[starts[count >= FREQUENT]]
    out: dict[str, list] = {"bucket": [], "frequent": [], "pairs": []}
    for is_hot, h, o in ((False, np.r_[hashes[~hot], marks], np.r_[owners[~hot], np.zeros(len(marks), np.int64)]), (True, hashes[hot], owners[hot])):
        if not len(h):
            continue
        by = (o.view(np.uint64) if is_hot else mix(h)) % np.uint64(buckets)
        order = np.argsort(by, kind="stable")
        h, o, by = h[order], o[order], by[order]
        cuts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(by)], strict=True):
            out["bucket"].append(int(by[a]))
            out["frequent"].append(is_hot)
            out["pairs"].append(_packed(h[a:b], o[a:b]))
    return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("frequent", pa.bool_()), ("pairs", pa.binary())]))


POSTINGS = "bucket int, frequent boolean, pairs binary"


def postings(docs: DataFrame, k: int, percent: int, buckets: int, text: str) -> DataFrame:
    """(bucket, frequent, pairs): the shingles that are counted, with the first keys of their sets, packed by hash bucket.

    Of copies within one piece of text only one counts. A shingle that FREQUENT sets of the piece have
    is known to be frequent: its bucket gets one mark of that (key 0), and its pairs go, marked
    frequent, to the buckets of their sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            values, offsets = shingle_sets(batch.column("text"), k)
            if (out := _dealt(set_keys(values, offsets), values, offsets, COUNTED, percent, buckets)) is not None:
                yield out

    return mapped(docs.select(F.col(text).alias("text")), run, POSTINGS)


def set_postings(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """postings() of all shingles of ``sets`` (key, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "set", 2 << 20):
            data, offsets = flat(batch.column("set"))
            if (out := _dealt(batch.column("key").to_numpy(), data.view(np.uint64), offsets // 8, ALL, percent, buckets)) is not None:
                yield out

    return mapped(sets.select("key", "set"), run, POSTINGS)


def _summed(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of their shingles, and how many sets have the shingle (FREQUENT at most, and where marked)."""
    order = np.lexsort((keys, hashes))
    hashes, keys = hashes[order], keys[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])]
    hashes, keys = hashes[new], keys[new]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    count = np.diff(np.r_[starts, len(hashes)])
    marked = np.maximum.reduceat(keys == 0, starts)
    return hashes, keys, np.repeat(np.where(marked, FREQUENT, np.minimum(count, FREQUENT)), count)


@lean
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shingle, sets): the pairs of a bucket whose shingle two sets or more have.

    The bucket is read batch by batch. Pairs of shingles that have proved frequent go out at once and
    leave a mark, so what is held is at most FREQUENT pairs of each different shingle of the bucket.
    """

    def out(keys: np.ndarray, hashes: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hashes.view(np.int64)), pa.array(sets.astype(np.int32))], ["key", "shingle", "sets"])

    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    size, limit = 0, HELD
    for batch in batches:
        frequent = [_unpacked(p) for p, hot in zip(batch.column("pairs").to_pylist(), batch.column("frequent").to_pylist(), strict=True) if hot]
        plain = [_unpacked(p) for p, hot in zip(batch.column("pairs").to_pylist(), batch.column("frequent").to_pylist(), strict=True) if not hot]
        for hashes, keys in frequent:
            yield out(keys, hashes, np.full(len(keys), FREQUENT))
        held += plain
        size += sum(len(h) for h, _ in plain)
        if size > limit:
            hashes, keys, sets = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            gone = (sets == FREQUENT) & (keys != 0)
            yield out(keys[gone], hashes[gone], sets[gone])
            marks = np.unique(hashes[gone])
            held = [(np.r_[hashes[~gone], marks], np.r_[keys[~gone], np.zeros(len(marks), np.int64)])]
            size = len(held[0][0])
            limit = max(HELD, 2 * size)
    if size:
        hashes, keys, sets = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        keep = (sets > 1) & (keys != 0)
        yield out(keys[keep], hashes[keep], sets[keep])


@lean_table
def _rarest(percent: int, counted_below: int, keys_only: bool, classes: pa.Table, shared: pa.Table) -> pa.Table:
    """(shingle, key, n): the prefix shingles, under the order by rarity, that other sets have too.

    The order: counted shingles before others, then the number of sets that sent it (up to FREQUENT),
    then the hash. Shingles of one set only are not listed but take their places in the prefix.
    ``keys_only``: each key once, with shingle and n 0; keys that two classes have are all among them.
    """
    key, n, counted = (classes.column(c).to_numpy() for c in ("key", "n", "counted"))
    order = np.argsort(key)
    key, n, counted = key[order], n[order], counted[order]
    twice = np.unique(key[1:][key[1:] == key[:-1]]) if keys_only else key[:0]
    owner, shingle, sets = shared.column("key").to_numpy(), shared.column("shingle").to_numpy().view(np.uint64), shared.column("sets").to_numpy()
    if not len(owner) or not len(key):
        none = np.zeros(len(twice), np.int64)
        return pa.table({"shingle": none, "key": twice, "n": none})
    order = np.lexsort((-sets, shingle, owner))
    owner, shingle, sets = owner[order], shingle[order], sets[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])]
    owner, shingle, sets = owner[new], shingle[new], sets[new]
    late = shingle > np.uint64(counted_below - 1)
    order = np.lexsort((shingle, sets, late, owner))
    owner, shingle, late = owner[order], shingle[order], late[order]
    at = np.searchsorted(key, owner)
    early_listed = np.bincount(at[~late], minlength=len(key))
    late_listed = np.bincount(at[late], minlength=len(key))
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    early_alone = counted - early_listed
    late_alone = n - counted - late_listed
    place = np.where(late, counted[at] + late_alone[at] + nth - early_listed[at], early_alone[at] + nth)
    keep = place < prefix_length(n, percent)[at]
    if keys_only:
        found = np.union1d(owner[keep], twice)
        return pa.table({"shingle": np.zeros(len(found), np.int64), "key": found, "n": np.zeros(len(found), np.int64)})
    return pa.table({"shingle": shingle[keep].view(np.int64), "key": owner[keep], "n": n[at][keep]})


def order_prefixes(values: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, offsets) of the sets' prefixes under each further order; 32 bits of each shingle's place in it."""
    n = np.diff(offsets)
    row, wanted = np.repeat(np.arange(len(n)), n), prefix_length(n, percent)
    out = []
    for seed in ORDERS:
        hashed = mix(values ^ np.uint64(seed))
        hashed = hashed[np.lexsort((hashed, row))]
        first = np.arange(len(row)) - offsets[:-1][row] < wanted[row]
        out.append((hashed[first].astype(np.uint32).view(np.int32), np.r_[0, np.cumsum(np.minimum(wanted, n))]))
    return out


def orders_agree(left: str, right: str) -> Column:
    """Do two classes share a prefix shingle under every further order? Columns left + "0" and so on hold the prefixes."""
    agree = F.lit(True)
    for i in range(len(ORDERS)):
        agree = agree & F.arrays_overlap(f"{left}{i}", f"{right}{i}")
    return agree


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b, left, right) whose sets are similar, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "left"):
            (x, xs), (y, ys) = (flat(batch.column(c)) for c in ("left", "right"))
            x, y, xs, ys = x.view(np.uint64), y.view(np.uint64), xs // 8, ys // 8
            keep = [similar(x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]], percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return mapped(pairs.select("a", "b", "left", "right"), run, "a long, b long")


@lean_table
def _between(percent: int, table: pa.Table) -> pa.Table:
    """Links between different components of a block or of two blocks; one link for two components will do."""
    side, key, root = (table.column(c).to_numpy() for c in ("side", "key", "root"))
    data, offsets = flat(table.column("set").combine_chunks())
    sets = np.split(data.view(np.uint64), offsets[1:-1] // 8)
    n = np.array([len(s) for s in sets])
    two = len(np.unique(side)) > 1
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    # Which rows share a prefix shingle under each further order.
    agree = np.ones((len(n), len(n)), bool)
    for seed in ORDERS:
        hashed = [np.sort(mix(s ^ np.uint64(seed)))[:p] for s, p in zip(sets, prefix_length(n, percent), strict=True)]
        _, column = np.unique(np.concatenate(hashed), return_inverse=True)
        row = np.repeat(np.arange(len(n)), [len(h) for h in hashed])
        common = np.zeros((len(n), len(n)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for begin in range(0, int(column[-1]) + 1, 8192):
            a, b = np.searchsorted(column, (begin, begin + 8192))
            has = np.zeros((len(n), 8192), np.float32)
            has[row[a:b], column[a:b] - begin] = 1
            common += has @ has.T
        agree &= common > 0
    agree &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
    agree &= root[:, None] != root[None, :]
    agree &= (side[:, None] < side[None, :]) if two else np.triu(np.ones_like(agree), 1)
    links: list[tuple[int, int]] = []
    for i in np.flatnonzero(agree.any(1)):
        # Those that earlier links have joined to this row's component need no look.
        others = [j for j in np.flatnonzero(agree[i]) if find(int(root[j])) != find(int(root[i]))]
        if not others:
            continue
        many = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(sets[i], many), n[i] - 1)
        begins = np.r_[0, np.cumsum([n[j] for j in others])[:-1]]
        common = np.add.reduceat((sets[i][at] == many).astype(np.int64), begins)
        for j, c in zip(others, common, strict=True):
            if 100 * c >= percent * (n[i] + n[j] - c) and (x := find(int(root[i]))) != (y := find(int(root[j]))):
                parent[x] = y
                links.append((int(key[i]), int(key[j])))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _places(column: str, bits: int) -> list[Column]:
    """Places of a value in the sieve."""
    return [F.pmod(F.xxhash64(column, F.lit(i)), F.lit(bits)) for i in range(2)]


def _sieve(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the ids (doc_id)."""
    places = ids.select(F.explode(F.array(*_places("doc_id", bits))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
    found = words.toArrow()
    sieve = np.zeros(bits >> 6, np.int64)
    sieve[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return sieve.view(np.uint64)


def class_sets(docs: DataFrame, classes: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(key, n, set, p0, p1, ...) of each of ``classes`` (key, hash, hash2, doc_id: a text that has it).

    set: sorted 64-bit shingles, packed; p0 and so on: the prefixes under the further orders. Texts are
    chosen by a sieve of their ids, which is sent to all tasks and has bits in proportion to them; where
    it would get too large, by a join of the ids. What is let through beside them has other hashes or is
    a copy.
    """
    wanted = classes.count() * SIEVE_BITS_AN_ID
    bits = 1 << max(16, (wanted - 1).bit_length())
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = None
    if bits <= MOST_SIEVE_BITS:
        shared = docs.sparkSession.sparkContext.broadcast(_sieve(classes, bits))
        chosen = named.select("text", *[p.alias(f"s{i}") for i, p in enumerate(_places("doc_id", bits))])
    else:
        ids = classes.select(F.col("doc_id").alias("_id"))
        chosen = named.join(ids, named["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("text")
    names = [f"p{i}" for i in range(len(ORDERS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            keep = np.ones(whole.num_rows, bool)
            for c in ("s0", "s1") if shared else ():
                p = whole.column(c).to_numpy()
                keep &= shared.value[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1) == 1
            for batch in pieces([whole.select(["text"]).filter(pa.array(keep))], "text", PIECE):
                values, offsets = shingle_sets(batch.column("text"), k)
                prefixes = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(p)) for p, ends in order_prefixes(values, offsets, percent)]
                keys = [pa.array(set_keys(values, offsets, half)) for half in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.diff(offsets)), binary(values.view(np.uint8), offsets * 8), *prefixes], ["hash", "hash2", "n", "set", *names])

    found = mapped(chosen, run, "hash long, hash2 long, n long, set binary, " + ", ".join(f"{c} array<int>" for c in names))
    return found.join(classes.select("hash", "hash2", "key"), ["hash", "hash2"]).select("key", "n", "set", *names).dropDuplicates(["key"])


def rare_prefixes(posted: DataFrame, classes: DataFrame, counted: int, percent: int, buckets: int, keys_only: bool = False) -> DataFrame:
    """(shingle, key, n) from postings and their ``classes`` (key, n, counted); see _rarest()."""
    shared = posted.groupBy("bucket").applyInArrow(_shared, "key long, shingle long, sets int")
    dealt = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("d")
    return shared.groupBy(dealt).cogroup(classes.select("key", "n", "counted").groupBy(dealt)).applyInArrow(lambda s, c: _rarest(percent, counted, keys_only, c, s), "shingle long, key long, n long")


def _blocks(rest: DataFrame, percent: int) -> DataFrame:
    """(key, root, bin, block) for the rows (shingle, often, key, root, n) of classes that are still to be compared.

    Each component goes to the block of the most frequent of its shingles, so those that share much meet
    in one; components and shingles with more than BLOCK classes, or BLOCK_SHINGLES shingles in these,
    are cut by hash. The classes of a block are of one bin of sizes: classes whose bins aren't the same
    or next to each other differ too much in size to be similar.
    """
    anchor = rest.groupBy("root").agg(F.max(F.struct("often", "shingle")).alias("at")).select("root", F.col("at.shingle").alias("anchor"))
    # Similar sizes differ by a factor of 100 / percent at most; rounding must not part them by more than a bin.
    sizes = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.0001 if percent < 100 else 1.0)).cast("int").alias("bin")
    member = rest.select("key", "root", "n", sizes).distinct().join(anchor, "root")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    own = member.groupBy("root", "bin").agg(parts.alias("own"))
    size = member.groupBy("anchor", "bin").agg(parts.alias("all"))
    cut = member.join(own, ["root", "bin"]).join(size, ["anchor", "bin"])
    large = F.col("own") > 1
    part = F.when(large, F.pmod(F.xxhash64("key"), F.col("own"))).otherwise(F.pmod(F.xxhash64("root"), F.col("all")))
    return cut.select("key", "root", "bin", F.xxhash64("anchor", "bin", part, F.when(large, F.col("root"))).alias("block"))


def _buckets(pairs: int | None) -> int:
    """Enough buckets for so many pairs."""
    return max(16, -(-(pairs or 0) // PAIRS_A_BUCKET))


def active_classes(docs: DataFrame, profile: DataFrame, classes: DataFrame, k: int, percent: int, text: str) -> DataFrame:
    """(key, n, hash, hash2, doc_id): the classes with a prefix shingle that others have, numbered by ``key``.

    Classes are known by the first half of their key alone until here; where two share it both stay.
    """
    short = F.col("counted") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    buckets = _buckets(profile.agg(F.sum(F.when(short, F.col("n")).otherwise(F.col("counted")))).first()[0])
    early = rare_prefixes(postings(docs, k, percent, buckets, text), classes, COUNTED, percent, buckets, True)
    found = early.select("key").distinct().join(classes, "key")
    return found.select((F.monotonically_increasing_id() + 1).alias("key"), "n", F.col("key").alias("hash"), F.col("key2").alias("hash2"), "doc_id")


def links_of(docs: DataFrame, active: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(a, b): links between active classes that make the same components as all links do."""
    sets = written(class_sets(docs, active, k, percent, doc_id, text), "join-sets")
    # The same among those that are left, over all their shingles.
    buckets = _buckets(active.agg(F.sum("n")).first()[0])
    prefixes = rare_prefixes(set_postings(sets, percent, buckets), active.withColumn("counted", F.col("n")), ALL, percent, buckets)
    prefixes = written(prefixes, "join-prefixes")
    # A pivot for each shingle; sums are taken before rows are dealt by shingle.
    pivots = prefixes.groupBy("shingle").agg(F.min(F.struct("key", "n")).alias("pivot"), F.count("*").alias("sets")).filter("sets > 1")
    near = prefixes.join(pivots, "shingle").select(F.col("pivot.key").alias("a"), F.col("key").alias("b"), F.col("pivot.n").alias("m"), "n", "shingle")
    near = written(near, "join-near")
    fits = F.least("m", "n") * 100 >= F.greatest("m", "n") * percent
    pairs = near.filter((F.col("a") != F.col("b")) & fits).select("a", "b").distinct()
    # The further orders, before any set is fetched.
    places = [f"p{i}" for i in range(len(ORDERS))]
    side = lambda key, name: sets.select(F.col("key").alias(key), *[F.col(p).alias(f"{name}{i}") for i, p in enumerate(places)])
    pairs = written(pairs.join(side("a", "l"), "a").join(side("b", "r"), "b").filter(orders_agree("l", "r")).select("a", "b"), "join-candidates")
    first = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("left")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("right")), "b")
    star = written(_verified(first, percent), "join-star")
    roots = components(star, "join-roots").withColumnsRenamed({"node": "b"})
    # Classes that share a prefix shingle and are of different components yet.
    rest = near.select("shingle", "b", "n").join(roots, "b", "left").select("shingle", F.col("b").alias("key"), F.coalesce("root", "b").alias("root"), "n")
    mixed = rest.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("often")).filter("low <> high").select("shingle", "often")
    rest = written(rest.join(mixed, "shingle"), "join-rest")
    member = written(_blocks(rest, percent), "join-blocks")
    # Blocks meet if they share a shingle that classes of different components have.
    at = rest.select("shingle", "key").join(member, "key").select("shingle", "bin", "block").distinct()
    pairs = at.alias("x").join(at.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") <= F.col("y.block")) & (F.abs(F.col("x.bin") - F.col("y.bin")) <= 1)).select(F.col("x.block").alias("p"), F.col("y.block").alias("q")).distinct()
    sides = F.array_distinct(F.array(F.struct(F.col("p").alias("block"), F.lit(0).alias("side")), F.struct(F.col("q").alias("block"), F.when(F.col("p") == F.col("q"), 0).otherwise(1).alias("side"))))
    work = pairs.select("p", "q", F.explode(sides).alias("of")).select("p", "q", "of.block", "of.side").join(member, "block").join(sets, "key")
    later = work.select("p", "q", "side", "key", "root", "set").groupBy("p", "q").applyInArrow(lambda t: _between(percent, t), "a long, b long")
    return star.union(later)


def ngram_join(docs: DataFrame, k: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Link texts whose sets of k-word shingles have a Jaccard similarity of percent / 100 or more.

    Words are runs of other than white space, A-Z lower-cased. Returns doc_id, n_shingles and
    component_id, the smallest doc_id reachable by links, for each row of ``docs``. A text of fewer
    than k words is one shingle; null, empty and blank texts have none and link with nothing. Repeated
    rows and copies are linked. Rows without an id take part; a component in which no row has one has
    a null component_id. An empty table gives an empty one. Other columns are not used or returned.

    No pair is lost: what is skipped are pairs already joined through others. One text's shingles are
    held in one task, those of a bucket in another; neither grows with the number of texts. A class of
    equal sets has a key of 128 bits and is one row wherever classes are joined; the rows of very many
    copies meet it in the last join only, whose partitions Spark splits where they are skewed.
    """
    profile = written(profiles(docs, k, doc_id, text), "join-profile")
    full = profile.filter("n > 0")
    classes = written(full.groupBy("key", "key2").agg(F.first("n").alias("n"), F.first("counted").alias("counted"), F.min("doc_id").alias("doc_id")), "join-classes")
    active = written(active_classes(docs, full, classes, k, percent, text), "join-active")
    links = written(links_of(docs, active, k, percent, doc_id, text), "join-links")
    roots = components(links, "join-components").withColumnsRenamed({"node": "key"})
    rooted = active.select("key", "hash", "hash2", "doc_id").join(roots, "key")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    moved = rooted.join(least, "root").select(F.col("hash").alias("key"), F.col("hash2").alias("key2"), "least", F.lit(True).alias("moved"))
    # One row for each class.
    named = classes.select("key", "key2", "doc_id").join(moved, ["key", "key2"], "left")
    named = written(named.select("key", "key2", F.when(F.col("moved"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id")), "join-named")
    out = full.join(named, ["key", "key2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(profile.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
