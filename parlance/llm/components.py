"""Connected components of a graph in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, name: str = "graph") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the smallest node that it reaches.

    Stars are formed in turn over larger and smaller neighbours until nothing changes, in a number of
    rounds that grows with the logarithm of the longest path. Each round sums before it shuffles, so a
    node with very many neighbours is no large group; its table is written to the shared folder.
    Loops, repeated and reversed edges are allowed; rows with a null are left out.
    """
    clean = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    alone = clean.filter("a = b").select("a", "b")
    now = written(clean.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        large = _large_star(now).filter("a <> b").distinct()
        after = written(_small_star(large).filter("a <> b").distinct(), name)
        mark = [F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")]
        settled = now.agg(*mark).collect() == after.agg(*mark).collect()
        now = after
        if settled:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stars.select("root").distinct().select(F.col("root").alias("node"), "root")
    return stars.union(roots).union(alone.join(stars, alone["a"] == stars["node"], "left_anti").select(F.col("a").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
