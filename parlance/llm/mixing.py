"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Bits of a document's hash that each histogram resolves, and how many histograms there are.
LEVEL_BITS, LEVELS = 12, 5


def n_words(text: str) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: str, seed: str) -> Column:
    """60 bits of a keyed hash of the id: where the document stands between 0 and 2^60."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """(source, source_size) with weight and target.

    The sources, by code point with null last, weigh ``weights`` in turn and share the sum of all
    sizes; no target exceeds ``ceiling`` times its source's size, and what is above goes to the rest by
    weight until none is above. That is the level at which sum(min(level * weight, ceiling * size)) is
    the total, found in one pass over the sources ordered by ceiling * size / weight. There is one row
    for each source here, not for each document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_room = Window.orderBy("room", F.col("source").isNull(), "source")
    given = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(given, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(ceiling))).withColumn("room", F.col("cap") / F.col("weight"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("level", level)
    # The first source by room whose cap is not below the level sets it for all after it; after that one, "level" only falls.
    levelled = levelled.withColumn("held", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("held"), F.col("room")) * F.col("weight"))
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def thresholds(sized: DataFrame, budgets: DataFrame, levels: int = LEVELS, bits: int = LEVEL_BITS) -> DataFrame:
    """For each (source, budget) the 60-bit threshold under which the sizes sum to about the budget.

    ``sized`` has source, size, at (the document's place). Each level sums sizes by source and
    ``bits`` bits of the place, finds the bucket in which the running sum crosses the budget, and the
    next level looks at the documents of that bucket only; documents are never sorted. A larger budget
    never has a lower threshold, so the documents taken are nested. The last bucket holds documents of
    one place; it is taken if that comes nearer to the budget.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(levels):
        shift = bits * (levels - 1 - level)
        s = state.alias("s")
        # Of the first level every document takes part; of the others, those in the boundary buckets.
        inside = sized.alias("d").join(s, _same(F.col("d.source"), F.col("s.source")) & (F.shiftright(F.col("d.at"), shift + bits) == F.col("s.prefix")))
        histogram = inside.groupBy(F.col("s.source").alias("source"), F.col("s.budget").alias("budget"), F.col("s.below").alias("below"), F.shiftright(F.col("d.at"), shift).alias("bucket")).agg(F.sum("d.size").alias("size"))
        running = Window.partitionBy("source", "budget").orderBy("bucket")
        summed = histogram.withColumn("upto", F.col("below") + F.sum("size").over(running))
        crossed = (F.col("upto") - F.col("size") / 2 > F.col("budget")) if level == levels - 1 else (F.col("upto") > F.col("budget"))
        first = summed.filter(crossed).groupBy("source", "budget").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("below")), F.col("bucket")).alias("at"))
        last = F.lit(1 << bits) + F.shiftleft(F.col("s.prefix"), bits)
        # Where nothing crosses, all of the bucket is taken: the threshold is its end.
        joined = s.join(first.alias("f"), _same(F.col("s.source"), F.col("f.source")) & (F.col("s.budget") == F.col("f.budget")), "left")
        state = written(joined.select(F.col("s.source").alias("source"), F.col("s.budget").alias("budget"), F.coalesce(F.col("f.at.bucket"), last).alias("prefix"), F.coalesce(F.col("f.at.below"), F.col("s.below")).alias("below")), f"mix-level{level}")
    return state.select("source", "budget", F.col("prefix").alias("threshold"))


def plan(sized: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """(source, source_size, target, whole, threshold): one row for each source.

    Every document of a source is taken ``whole`` times, and once more if its place is below the threshold.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, ceiling)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(share).cast("long"))
    targets = written(targets.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    cuts = thresholds(sized, targets)
    both = targets.alias("t").join(cuts.alias("c"), _same(F.col("t.source"), F.col("c.source")))
    return written(both.select("t.source", "t.source_size", "t.target", "t.whole", "c.threshold"), "mix-plan")


def _sized(docs: DataFrame, seed: str, doc_id: str, text: str, source: str) -> DataFrame:
    return written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), place(doc_id, seed).alias("at")), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many copies of each document the mix takes.

    Returns one row for each row of ``docs``: doc_id, size (words), source_size, target (its source's),
    copies, taken (size * copies). A source with a target of r times its size gives floor(r) copies of
    every document and one more of those below its hash threshold, but never more than ``ceiling``. Null text: size 0. A null source is
    a source of its own, the last. Rows of one id, and all rows without an id, stand at one place and
    are taken together. Where all sizes are 0 every target is 0. Other columns of ``docs`` are not used
    or returned. The size of every document is computed once and written to the shared folder; what
    follows reads that narrow table. The tables of sources have one row for each source; Spark
    broadcasts them or not by the size of their files.
    """
    sized = _sized(docs, seed, doc_id, text, source)
    d, p = sized.alias("d"), plan(sized, weights, ceiling).alias("p")
    copies = F.col("p.whole") + F.when((F.col("d.at") < F.col("p.threshold")) & (F.col("p.whole") < ceiling), 1).otherwise(0)
    joined = d.join(p, _same(F.col("d.source"), F.col("p.source")))
    return joined.select("d.doc_id", "d.size", "p.source_size", "p.target", copies.alias("copies"), (F.col("d.size") * copies).alias("taken"))


def taken(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as mix() takes them. No text is shuffled."""
    p = plan(_sized(docs, seed, doc_id, text, source), weights, ceiling).alias("p")
    d = docs.alias("d")
    copies = F.col("p.whole") + F.when((place(f"d.{doc_id}", seed) < F.col("p.threshold")) & (F.col("p.whole") < ceiling), 1).otherwise(0)
    chosen = d.join(p, _same(F.col(f"d.{source}"), F.col("p.source"))).filter(copies > 0)
    return chosen.select(F.struct("d.*").alias("row"), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("nth")).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight FROM s),
l AS (
  SELECT *, cap / weight AS room,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= room THEN level END) OVER (), room) * weight) AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
u AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE UNBOUNDED PRECEDING) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.place) AS here
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (whole + CASE WHEN upto - here / 2.0 > budget OR whole >= 3 THEN 0 ELSE 1 END)::BIGINT AS copies,
       (size * (whole + CASE WHEN upto - here / 2.0 > budget OR whole >= 3 THEN 0 ELSE 1 END))::BIGINT AS taken
FROM u
"""
