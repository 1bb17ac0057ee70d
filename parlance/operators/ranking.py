"""Ranking of passages: BM25 of one question without an index, and fusion of two rankings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import tokens

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
DAMPING = 60


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda t: t == F.lit(word)


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of the texts with one of the terms, higher is better; each term counts once.

    Counts of the few terms are taken within each row, so only rows that match leave the scan, and no
    posting list of the corpus is built for one question. Statistics are those of the whole table.
    """
    words = docs.select(key, tokens(F.col(text)).alias("_t"))
    wanted = list(dict.fromkeys(terms))
    counts = [F.size(F.filter("_t", _equals(w))).alias(f"tf{i}") for i, w in enumerate(wanted)]
    # A generator of one row: conditions on the counts stay above it, so each text is cut into words once.
    counted = words.select(key, F.inline(F.array(F.struct(F.size("_t").alias("len"), *counts))))
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    matched = counted.filter(" OR ".join(f"tf{i} > 0" for i in range(len(wanted))) or "false")
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.ln((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        score += F.when(idf > 0, idf).otherwise(LEAST_IDF) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    # One row of statistics.
    return matched.crossJoin(F.broadcast(stats)).select(key, score.alias("score"))


def fused(lexical: DataFrame, semantic: DataFrame, key: str, damping: int = DAMPING) -> DataFrame:
    """(key, score): sum of 1 / (damping + pos + 1) over two ranked lists."""
    both = lexical.select(key, "pos").unionByName(semantic.select(key, "pos"))
    return both.groupBy(key).agg(F.sum(F.lit(1.0) / (F.col("pos") + damping + 1)).alias("score"))
