"""Whitening of embeddings from exact moments: products of whole numbers by slices of digits.

Values are whole numbers far from zero, so a covariance from rounded sums would lose most of its digits.
Each whole number is cut into limbs of 16 bits; the product of two limbs is below 2^32, so a float64
matrix product over up to 2^20 rows is exact, and the limbs' sums are put together as big integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .common import written

LIMB = 16
#: Rows of one exact product: 2^20 products below 2^32 stay below 2^53, with a bit to spare for signs.
BLOCK = 1 << 20
#: Partial sums are merged by so many slots of a matrix row before they meet, as the tasks may be very many.
SLOTS = 64
#: Whitened values are whole numbers of 2^-24 when their covariance is taken.
FRACTION = 24


@dataclass(frozen=True)
class Moments:
    """n vectors' sums by dimension and sums of products of two dimensions, exact."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def covariance(self) -> np.ndarray:
        """(n * products - sums x sums) / n^2: whole numbers up to the one division, so centred without rounding."""
        square = self.n * self.n
        return np.array([[(self.n * p - a * b) / square for p, b in zip(row, self.sums, strict=True)] for row, a in zip(self.products, self.sums, strict=True)])


@dataclass(frozen=True)
class Whitening:
    """What turns centred vectors into whitened ones. Its size is that of a few vectors' squares, whatever the rows."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues of the components, falling
    vectors: np.ndarray  # one column a component
    explained: np.ndarray  # eigenvalue by trace


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """The digits of whole numbers to base 2^16 as float64, lowest first; all but the highest are not negative.

    There are as many as the numbers need: two for values up to 2^31, four at most.
    """
    if not x.size:
        return []
    top, found = max(int(x.max()), -1 - int(x.min())), []
    while top >= 1 << (LIMB - 1):
        found.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x, top = x >> LIMB, top >> LIMB
    return [*found, x.astype(np.float64)]


class Sums:
    """Adds up blocks of rows: limb by limb in 64 bits, and as big integers at the end."""

    def __init__(self, dimensions: int):
        self.d = dimensions
        self.n = 0
        self.sums: dict[int, np.ndarray] = {}
        self.products: dict[int, np.ndarray] = {}
        self.whole = np.zeros((dimensions, dimensions + 1), object)
        self.pending = 0

    def add(self, x: np.ndarray) -> None:
        for a in range(0, len(x), BLOCK):
            block = x[a : a + BLOCK]
            digits = limbs(block)
            for i, low in enumerate(digits):
                self.sums[i] = self.sums.get(i, 0) + low.sum(axis=0).astype(np.int64)
                for j, high in enumerate(digits[: i + 1]):
                    product = (low.T @ high).astype(np.int64)
                    self.products[i + j] = self.products.get(i + j, 0) + (product if i == j else product + product.T)
            self.n += len(block)
            self.pending += len(block)
            # Eight products below 2^32 a row leave room for 2^28 rows in 64 bits.
            if self.pending > 1 << 27:
                self._recombine()

    def _recombine(self) -> None:
        for shift, part in self.products.items():
            self.whole[:, : self.d] += part.astype(object) << (LIMB * shift)
        for shift, part in self.sums.items():
            self.whole[:, self.d] += part.astype(object) << (LIMB * shift)
        self.sums, self.products, self.pending = {}, {}, 0

    def rows(self) -> list[list[str]]:
        """For each dimension its products with all dimensions and its sum, in decimal."""
        self._recombine()
        return [[str(int(v)) for v in row] for row in self.whole]


def _merged(parts: DataFrame, slots: bool) -> DataFrame:
    """Adds up partial sums of a matrix row as big integers."""

    def run(table: pa.Table) -> pa.Table:
        total = sum((np.array([int(v) for v in row], object) for row in table.column("parts").to_pylist()), 0)
        first = table.slice(0, 1).select(["dimension", "slot"])
        return first.append_column("n", pa.array([sum(table.column("n").to_pylist())], pa.int64())).append_column("parts", pa.array([[str(v) for v in total]], pa.list_(pa.string())))

    keys = ["dimension", "slot"] if slots else ["dimension"]
    return parts.groupBy(*keys).applyInArrow(run, "dimension int, slot int, n long, parts array<string>")


def moments(vectors: DataFrame, dimensions: int, column: str = "x") -> Moments:
    """The exact moments of a column of equally long arrays of longs.

    Each task adds up its own rows and hands on one row for each dimension; these are merged first within
    slots, then to one row a dimension, which the driver reads: dimensions^2 numbers, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(dimensions)
        for batch in batches:
            sums.add(_matrix(batch.column(0), dimensions))
        if sums.n:
            rows = sums.rows()
            yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), pa.array([sums.n] * dimensions, pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["dimension", "n", "parts"])

    parts = mapped(vectors.select(column), run, "dimension int, n long, parts array<string>")
    slotted = parts.select("dimension", (F.spark_partition_id() % SLOTS).alias("slot"), "n", "parts")
    rows = sorted(_merged(_merged(slotted, True), False).collect(), key=lambda r: r["dimension"])
    if not rows:
        return Moments(0, [0] * dimensions, [[0] * dimensions for _ in range(dimensions)])
    whole = [[int(v) for v in r["parts"]] for r in rows]
    return Moments(rows[0]["n"], [r[-1] for r in whole], [r[:-1] for r in whole])


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def prepared(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id and x, the whole numbers floor(scale * c) + offset of each vector without null or non-finite entries.

    Numbers that no long holds are the nearest that one holds.
    """
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf))
    fine = F.col(vector).isNotNull() & ~F.exists(vector, entry)
    x = F.transform(vector, lambda c: F.least(F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"), F.lit((1 << 63) - 1 - offset).cast("long")) + F.lit(offset).cast("long"))
    return embeddings.filter(fine).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def fit(vectors: DataFrame, dimensions: int, components: int = 32) -> Whitening:
    """The leading components of equally long vectors of whole numbers (column x)."""
    found = moments(vectors, dimensions)
    if not found.n:
        return Whitening(0, tuple(found.sums), np.zeros(0), np.zeros((dimensions, 0)), np.zeros(0))
    covariance = found.covariance()
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    # Directions in which the vectors don't differ have no scale to be whitened by.
    least = max(values.max(), 0) * dimensions * np.finfo(float).eps
    order = order[values[order] > least]
    return Whitening(found.n, tuple(found.sums), values[order], directions[:, order], values[order] / np.trace(covariance))


def _deviations(x: np.ndarray, n: int, sums: Sequence[int]) -> tuple[np.ndarray, list[int]]:
    """(n * x - sums as float64, and each row's sum of its squares as whole numbers)."""
    top = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums))
    if top * top * x.shape[1] < 1 << 63:
        y = x * n - np.array(sums, np.int64)
        return y.astype(np.float64), (y * y).sum(axis=1).tolist()
    y = x.astype(object) * n - np.array(sums, object)
    return y.astype(np.float64), [int(v) for v in (y * y).sum(axis=1)]


def apply(vectors: DataFrame, model: Whitening, dimensions: int) -> DataFrame:
    """vec_id, deviation (decimal(38,0), null where even that is too small) and whitened (array of doubles) of each row."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scaled = m.vectors / np.sqrt(m.values) / m.n
        width = len(m.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, deviations = _deviations(_matrix(batch.column("x"), dimensions), m.n, m.sums)
            white = np.ascontiguousarray(y @ scaled)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * width, pa.int32()), pa.array(white.ravel()))
            deviation = pa.array([str(v) if len(str(v)) <= 38 else None for v in deviations], pa.string()).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return mapped(vectors.select("vec_id", "x"), run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def dimension(vectors: DataFrame) -> int:
    """The commonest length of the vectors (the longest of equally common ones); 0 where there are none."""
    found = vectors.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return found["length"] if found else 0


def whiten(embeddings: DataFrame, components: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each vector's leading components, whitened.

    Rows whose vector is null or holds null or non-finite entries are dropped, and so are those whose vector
    isn't as long as most are. All others count, repeated ones and those without an id too; other columns
    are not used. Components are those of the covariance of whole numbers (see prepared()), by falling
    eigenvalue; directions in which the vectors don't differ are left out, so equal vectors, or one alone,
    give no rows, nor does an empty table. ``deviation`` is exact: decimal(38,0). ``identity_error`` is the
    largest entry of the whitened rows' own covariance, taken in whole numbers of 2^-24, beside the identity.
    """
    spark = embeddings.sparkSession
    ready = prepared(embeddings, vec_id, vector)
    d = dimension(ready)
    kind = ready.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    ready = ready.filter(F.size("x") == d)
    model = fit(ready, d, components)
    width = len(model.values)
    if not width:
        return spark.createDataFrame([], schema)
    white = written(apply(ready, model, d), "whitened")
    rounded = white.select(F.transform("whitened", lambda z: F.round(z * float(1 << FRACTION)).cast("long")).alias("x"))
    again = moments(rounded, width).covariance() / float(1 << FRACTION) ** 2
    error = float(np.abs(again - np.eye(width)).max())
    explained = F.array(*(F.lit(float(v)) for v in model.explained))
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def digest(embeddings: DataFrame) -> DataFrame:
    """What the query returns: whiten() with deviation as a long, null where no long holds it."""
    return whiten(embeddings).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
