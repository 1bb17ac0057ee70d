"""How the sources of a language differ in their words: an audit by an inverted index with a baseline.

A pair of sources starts at the number of terms times the divergence of a term that neither has. The
postings of the terms then emit what differs from that: a term that one of the two has, counted by how
often it occurs there, and a term that both have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import mapped
from .common import written

#: What terms are made of, in UTF-8 after A-Z are lower-cased: a-z and all bytes of characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Shares are whole numbers, of so many parts.
PARTS = 1_000_000_000
#: A task adds up counts of different terms to about so many bytes before it hands them on. This bounds memory only.
HELD_BYTES = 32 << 20
ENTRY_BYTES = 150


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term (UTF-8 bytes), count and docs, added up within tasks only."""

    def out(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs_with) in held.items():
            terms = list(counts)
            for a in range(0, len(terms), 20_000):
                part = terms[a : a + 20_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array([counts[t] for t in part], pa.int64()), pa.array([docs_with[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                raw = text.encode().lower()
                terms = TERM.findall(raw)
                if not terms:
                    continue
                counts, docs_with = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(counts)
                counts.update(terms)
                docs_with.update(set(terms))
                size += (len(counts) - before) * (ENTRY_BYTES + 2 * len(raw) // len(terms))
                if size > HELD_BYTES:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return mapped(texts, run, "lang string, source string, term binary, count long, docs long")


def _share(count: Column | int, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / (total + terms)), exactly: in longs where the product is one, else in decimals."""
    count = F.lit(count).cast("long") if isinstance(count, int) else count
    whole = F.call_function("div", (count + 1) * PARTS, total + terms)
    product = F.lit(PARTS).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    large = F.call_function("div", product, (total + terms).cast("decimal(20,0)"))
    return F.when(count < 9_000_000_000, whole).otherwise(large) + F.expr("1L")


def _divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): shares are at most PARTS + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, at_least: int = 3, ranks: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others and from the language.

    Columns lang, source and text of ``docs`` are used, null as ''; others are not. Each language keeps the
    terms that at least ``at_least`` of its documents (rows) have. Part ``pair`` has every other source of
    the language, even those without terms, with the sum over all kept terms; part ``term`` has the
    ``ranks`` terms that the source uses most beyond the language's share. Repeated rows count as often as
    they are there; equal values are ranked by the item's UTF-8; an empty table gives an empty one, and a
    language without kept terms gives pairs of value 0.

    Terms are counted in the tasks that read them, so a source with a third of all rows shuffles no more
    than its different terms a task. That is the one shuffle of terms. A posting list, one row, has a
    language's sources that have the term; the result itself has every pair of these.
    """
    occurrences = _counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    lists = occurrences.groupBy("lang", "term").agg(F.sum("docs").alias("within"), F.sum("count").alias("overall"), F.collect_list(F.struct("source", "count")).alias("list"))
    postings = written(lists.filter(F.col("within") >= at_least).select("lang", "term", "overall", "list"), "divergence-postings")

    sources = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    in_source = postings.select("lang", F.inline("list")).groupBy("lang", "source").agg(F.sum("count").alias("total"))
    in_lang = postings.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("overall").alias("lang_total"))
    groups = written(
        sources.join(in_source, ["lang", "source"], "left").join(in_lang, "lang", "left").select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "terms"))),
        "divergence-groups",
    )
    pairs = written(_pairs(postings, groups), "divergence-pairs")
    known = postings.select("lang", "term", "overall", F.inline("list")).join(groups, ["lang", "source"])
    terms = known.select("lang", "source", F.col("term").cast("string").alias("item"), _share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("overall"), F.col("lang_total"), F.col("terms")).alias("q"))
    terms = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", _divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(order).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    return pairs.select(*columns, rank).unionByName(terms.select(*columns, rank).filter(F.col("rank") <= ranks))


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """The baseline of each ordered pair of sources, and the corrections that the postings emit.

    With f(p, q) of a term's shares in the pair's sources, p0 and q0 being those of a count of 0, the sum
    over all terms is
        terms * f(p0, q0)
        + sum of f(p, q0) - f(p0, q0) over the first source's terms,
        + sum of f(p0, q) - f(p0, q0) over the second one's,
        + sum of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) over the terms that both have.
    The first two sums need only how many terms have each count; the last one is emitted by each posting
    list for the pairs of its sources, in one direction, and summed before it is shuffled.
    """
    a = groups.select("lang", "terms", F.col("source").alias("a"), F.col("total").alias("a_total"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("b_total"))
    both = a.join(b, "lang").filter("a <> b")
    n, total_a, total_b = F.col("terms"), F.col("a_total"), F.col("b_total")
    zero_a, zero_b = _share(0, total_a, n), _share(0, total_b, n)
    base = both.select("lang", "a", "b", F.when(n > 0, n * _divergence(zero_a, zero_b)).otherwise(0).alias("value"))

    # How many terms of a source have each count.
    times = postings.select("lang", F.inline("list")).groupBy("lang", "source", "count").agg(F.count("*").alias("times"))
    one = both.filter("terms > 0").withColumn("zero", _divergence(zero_a, zero_b))
    first = one.join(times.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", (F.col("times") * (_divergence(_share(F.col("count"), total_a, n), zero_b) - F.col("zero"))).alias("value"))
    second = one.join(times.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", (F.col("times") * (_divergence(zero_a, _share(F.col("count"), total_b, n)) - F.col("zero"))).alias("value"))

    # Terms that both have: each two sources meet once, and the correction is that of both directions.
    left = postings.select("lang", "list", F.inline("list")).select("lang", "list", F.col("source").alias("a"), F.col("count").alias("a_count"))
    met = left.select("lang", "a", "a_count", F.explode(F.filter("list", lambda x: x["source"] > F.col("a"))).alias("x")).select("lang", "a", "a_count", F.col("x.source").alias("b"), F.col("x.count").alias("b_count"))
    met = met.groupBy("lang", "a", "b", "a_count", "b_count").agg(F.count("*").alias("times"))
    shared = met.join(both.filter("a < b"), ["lang", "a", "b"])
    shared = shared.select("lang", "a", "b", "times", _share(F.col("a_count"), total_a, n).alias("p"), _share(F.col("b_count"), total_b, n).alias("q"), zero_a.alias("p0"), zero_b.alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    correction = lambda p, q, p0, q0: F.col("times") * (_divergence(p, q) - _divergence(p, q0) - _divergence(p0, q) + _divergence(p0, q0))
    shared = shared.groupBy("lang", "a", "b").agg(F.sum(correction(p, q, p0, q0)).alias("there"), F.sum(correction(q, p, q0, p0)).alias("back"))
    shared = shared.select("lang", F.explode(F.array(F.struct("a", "b", F.col("there").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value")))).alias("x")).select("lang", "x.a", "x.b", "x.value")

    corrected = base.unionByName(first).unionByName(second).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return corrected.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")


ORACLE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), found AS (
    SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM docs
), words AS (
    SELECT id, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM found
), kept AS (
    SELECT lang, term, count(*) AS overall FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), counts AS (
    SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), totals AS (
    SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total FROM groups g
), langs AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(overall)::HUGEINT AS total FROM kept GROUP BY lang
), shares AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + l.v) AS p,
        1 + (1000000000::HUGEINT * (k.overall + 1)) // (l.total + l.v) AS of_lang
    FROM totals t JOIN langs l ON t.lang = l.lang JOIN kept k ON k.lang = t.lang
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - of_lang) * (p - of_lang) // of_lang)::BIGINT AS value FROM shares WHERE n > 0 AND p > of_lang
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
