"""Nearest vectors for many questions: blocks of a matrix product and a running best list in each task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.arrow import mapped

#: Scores that agree to so many places are equal, as sums of doubles depend on their order.
PLACES = 9
#: Rows of a block of vectors and of questions.
BLOCK = 2048


def _packed(rows: DataFrame, key: str, vector: str, names: tuple[str, str]) -> DataFrame:
    """Blocks of rows: the ids, ascending, and the vectors one after another, of one width in each block.

    Vectors that are null, empty, or hold nulls aren't scored by anything, so they are left out here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                widths = np.diff(lists.offsets.to_numpy())
                values = lists.flatten().to_numpy(zero_copy_only=False)
                begins = np.cumsum(widths) - widths
                for width in np.unique(widths):
                    at = np.flatnonzero(widths == width)
                    at = at[np.argsort(ids[at], kind="stable")]
                    matrix = values[begins[at][:, None] + np.arange(width)]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[at].tolist()], pa.list_(pa.int64())), pa.array([int(width)], pa.int32()), pa.array([matrix.astype("<f8").tobytes()], pa.binary())], [names[0], "width", names[1]])

    fine = rows.filter(F.col(key).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))
    return mapped(fine.select(F.col(key).cast("long").alias(names[0]), F.col(vector).cast("array<double>").alias(names[1])), run, f"{names[0]} array<long>, width int, {names[1]} binary")


class _Best:
    """The best rows of each question so far, by score and then by id."""

    def __init__(self, most: int):
        self.most = most
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, questions: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        for q, row in zip(questions.tolist(), scores, strict=True):
            keys, best = self.lists.get(q, (ids[:0], row[:0]))
            fine = np.isfinite(row)
            if len(best) >= self.most:
                fine &= row >= best[-1]
            elif fine.sum() > self.most:
                fine &= row >= np.partition(row[fine], -self.most)[-self.most]
            if not fine.any():
                continue
            keys, best = np.r_[keys, ids[fine]], np.r_[best, row[fine]]
            order = np.lexsort((keys, -best))[: self.most]
            self.lists[q] = keys[order], best[order]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for q, (keys, best) in self.lists.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), q)), pa.array(keys), pa.array(best)], ["question", "key", "score"])


def nearest_many(vectors: DataFrame, questions: DataFrame, most: int, key: str = "key", vector: str = "vector", question: str = "question") -> DataFrame:
    """(question, key, score, pos): for each question the ``most`` rows of greatest dot product, by score and id.

    Exhaustive: every row is scored for every question. Both sides are cut into blocks; a pair of blocks
    is one matrix product, and a task keeps the best rows of each of its questions, so no more than ``most``
    rows a question and task are shuffled. Where the questions' blocks are small, Spark broadcasts them;
    else its tasks are pairs of partitions. Vectors of another width than the question's, with nulls, or
    whose product isn't finite don't count, nor do rows without an id. Ids of questions are unique; rows
    of one id are one row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(most)
        for batch in batches:
            for row in batch.to_pylist():
                ids, asked = np.array(row["ids"], np.int64), np.array(row["asked"], np.int64)
                if row["width"] != row["wide"]:
                    continue
                left = np.frombuffer(row["wanted"], "<f8").reshape(len(asked), -1)
                right = np.frombuffer(row["matrix"], "<f8").reshape(len(ids), -1)
                with np.errstate(over="ignore", invalid="ignore"):
                    best.add(asked, ids, np.round(left @ right.T, PLACES))
        yield from best.rows()

    blocks = _packed(vectors, key, vector, ("ids", "matrix"))
    wanted = _packed(questions, question, vector, ("asked", "wanted")).withColumnRenamed("width", "wide")
    # The stated questions against all rows, block by block. Widths are compared in the tasks: as a join's key
    # they would bring all blocks of the one common width together.
    found = mapped(blocks.crossJoin(wanted), run, "question long, key long, score double")
    order = Window.partitionBy("question").orderBy(F.desc("score"), "key")
    return found.withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < most)
