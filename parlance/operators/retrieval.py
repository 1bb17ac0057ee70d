"""Answers to many questions at once: words and vectors fused by rank, then neighbours by shared links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import kind_weight
from parlance.operators import index, vectors
from parlance.operators.ranking import DAMPING
from parlance.sources.stored import written

PLACES = index.PLACES


@dataclass(frozen=True)
class Limits:
    """How much of each list is taken; the defaults are fixed values."""

    most: int = 20  # passages of an answer
    depth: int = 60  # passages of each ranking
    seeds: int = 3  # meetings whose neighbours are sought
    near: int = 4  # neighbours of a question
    of_neighbour: int = 3  # passages of a neighbour
    decay: float = 0.55  # of what a neighbour's passage scores
    unmatched: float = 0.25  # of the best score, for a neighbour without the question's words


def _first(rows: DataFrame, keys: list[str], order: list, most: int, name: str = "nth") -> DataFrame:
    """The ``most`` first rows of each group; Spark cuts each partition's groups before it shuffles them."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most)


def neighbours(links: DataFrame, seeds: DataFrame, visible: DataFrame, most: int, of_question: int) -> DataFrame:
    """(question, meeting, nth): the visible meetings that share most links with a question's seeds, ties by id.

    Meetings with one set of links differ by their ids alone, so of each set only the first few take part:
    as many as are wanted, and as many more as may be seeds themselves. A link that very many meetings have
    thus meets a question once for each different set, not once for each meeting. A set is known by its first meeting,
    and of a question's sets only as many go on as meetings may: each has one before all of a later set.
    """
    sets = links.join(visible, "meeting", "left_semi").groupBy("meeting").agg(F.array_sort(F.collect_set(F.struct("kind", "key"))).alias("links"))
    few = _first(sets, ["links"], ["meeting"], most + of_question)
    members = few.select(F.min("meeting").over(Window.partitionBy("links")).alias("alike"), "links", "meeting")
    linked = members.filter("meeting = alike").select("alike", F.inline("links"))
    wanted = links.join(seeds, "meeting").groupBy("question", "kind", "key").agg(F.count("*").alias("n"))
    shared = wanted.join(linked, ["kind", "key"]).groupBy("question", "alike").agg(F.sum("n").alias("shared"))
    best = _first(shared, ["question"], [F.desc("shared"), "alike"], most + of_question).drop("nth")
    found = best.join(members.select("alike", "meeting"), "alike").select("question", "meeting", "shared").join(seeds.select("question", "meeting"), ["question", "meeting"], "left_anti")
    return _first(found, ["question"], [F.desc("shared"), "meeting"], most).select("question", "meeting", "nth")


def retrieve(words: index.Index, cards: DataFrame, embedded: DataFrame, links: DataFrame, visible: DataFrame, questions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(question, pos, key, meeting, score, origin): what an audience may read for each question, best first.

    ``cards``: key, meeting, kind, start_ms, started_at and said (a digest of the text) of each passage;
    ``embedded``: key, vector; ``links``: meeting, kind, key; ``visible``: meeting; ``questions``: question,
    terms, vector (null: words alone). Texts aren't read. Statistics of words are those of the whole index;
    all else is of visible meetings only.

    Two rankings of ``depth`` passages are fused by rank, passages of one meeting and text as one, times the
    weight of their kind; where one ranking is empty the other stays as it is. The first meetings in the
    order of the lists lead to their neighbours, whose passages with the question's words count ``decay``
    times, or else, for want of such, their summary or beginning a share of the first score. A question
    without terms has no neighbours. Equal scores: the later meeting first, then the order of the lists.
    Of neighbouring rows of one meeting and text one stays.
    """
    cards = cards.join(visible, "meeting", "left_semi")
    mine = cards.select("key")
    asked = questions.select("question", "terms").filter(F.size("terms") > 0)
    lexical = index.search(words, asked, limits.depth, mine).select("question", "key", "score", "pos", F.lit(1).alias("list"))
    close = vectors.nearest_many(embedded.join(mine, "key", "left_semi"), questions.filter("vector IS NOT NULL").select("question", "vector"), limits.depth)
    both = lexical.unionByName(close.select("question", "key", "score", "pos", F.lit(2).alias("list")))
    both = both.join(cards, "key").withColumn("lists", F.size(F.collect_set("list").over(Window.partitionBy("question"))))

    place = F.struct("list", "pos")
    same = both.groupBy("question", "lists", "meeting", "said", F.when(F.col("lists") == 1, F.col("key")).alias("apart"))
    one = same.agg(F.min_by(F.struct("key", "kind", "score", "started_at", "list"), place).alias("first"), F.min(place).alias("place"), F.sum(F.lit(1.0) / (F.col("pos") + DAMPING + 1)).alias("ranks"))
    weight = kind_weight(F.col("first.kind"))
    alone = F.when(F.col("first.list") == 1, F.col("first.score") * weight).otherwise(F.col("first.score"))
    direct = one.select("question", "meeting", "said", "place", "first.key", "first.started_at", F.round(F.when(F.col("lists") > 1, F.col("ranks") * weight).otherwise(alone), PLACES).alias("score"))
    # Used several times below; written, so that both rankings are made once.
    direct = written(direct, "direct")

    meetings = direct.groupBy("question", "meeting").agg(F.min("place").alias("place"))
    seeds = _first(meetings, ["question"], ["place"], limits.seeds).join(asked.select("question"), "question", "left_semi").select("question", "meeting")
    best = direct.groupBy("question").agg(F.min_by("score", "place").alias("best"))
    around = written(neighbours(links, seeds, visible, limits.near, limits.seeds), "around")

    theirs = around.join(cards, "meeting")
    scored = index.scores(words, asked, theirs.select("question", "key"))
    matched = _first(theirs.join(scored, ["question", "key"]), ["question", "meeting"], [F.desc("score"), "key"], limits.of_neighbour, "mth")
    matched = written(matched.withColumn("score", F.col("score") * kind_weight(F.col("kind")) * limits.decay), "matched")
    silent = theirs.join(matched.select("question", "meeting"), ["question", "meeting"], "left_anti")
    # What was distilled, in this order; where there is nothing, how the meeting began.
    rank = F.when(F.col("kind") == "overview", 0).when(F.col("kind") == "decision", 1).when(F.col("kind") == "key_point", 2).when(F.col("kind") == "transcript", 3)
    ranked = silent.withColumn("rank", rank).filter("rank IS NOT NULL")
    told = _first(ranked, ["question", "meeting"], ["rank", F.when(F.col("rank") == 3, F.col("start_ms")), "key"], limits.of_neighbour, "mth").filter("rank < 3 OR mth = 1")
    told = told.join(best, "question").withColumn("score", F.col("best") * limits.unmatched)
    columns = ["question", "meeting", "said", "key", "started_at", F.round("score", PLACES).alias("score"), F.struct((F.col("nth") + 2).alias("list"), F.col("mth").alias("pos")).alias("place")]
    found = direct.withColumn("origin", F.lit("direct")).unionByName(matched.select(*columns).withColumn("origin", F.lit("neighbour"))).unionByName(told.select(*columns).withColumn("origin", F.lit("context")))

    order = Window.partitionBy("question").orderBy(F.desc("score"), F.desc("started_at"), "place", "key")
    before = F.lag(F.struct("meeting", "said")).over(order)
    kept = found.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.struct("meeting", "said")))
    return kept.withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < limits.most).select("question", "pos", "key", "meeting", "score", "origin")
