"""Order-dependent operators: islands of turns, size-bounded windows, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: str, order: list[str], key: list[str]) -> DataFrame:
    """``rows`` with island: a number that grows where ``key`` differs from the row before, in each ``by``."""
    w = Window.partitionBy(by).orderBy(*order)
    changed = ~F.struct(*key).eqNullSafe(F.lag(F.struct(*key)).over(w))
    return rows.withColumn("island", F.sum(changed.cast("int")).over(w))


def merged_turns(rows: DataFrame, by: str = "meeting_id", key: tuple[str, ...] = ("speaker",), blanks: bool = False) -> DataFrame:
    """Consecutive utterances of one key as one turn: first start, last end, texts joined by a space.

    Blank texts are left out before keys are compared, or with ``blanks`` after it, and then turns that
    are blank.
    """
    kept = rows if blanks else rows.filter(F.trim("text") != "")
    parts = islands(kept, by, ["start_ms", "seq"], list(key))
    texts = F.array_sort(F.collect_list(F.struct("start_ms", "seq", F.trim("text").alias("text"))))
    out = parts.groupBy(by, "island", *key).agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "seq")).alias("end_ms"), F.array_join(F.filter(F.transform(texts, lambda t: t["text"]), lambda t: t != ""), " ").alias("text"))
    return out.filter("text <> ''")


def size_windows(items: Column, size: Column | None = None, most: int = 900) -> Column:
    """Windows of items (array of struct with ``text``) of about ``most`` bytes, overlapping by one item.

    A window is closed when it has an item and the next would make it longer; its last item then begins
    the next window too, if the window had more than one. The item after that is added unchecked.
    """
    empty = F.array().cast("array<struct<text:string>>") if size is None else size
    length = lambda t: F.octet_length(t["text"])

    def step(at: Column, t: Column) -> Column:
        close = (F.size(at["open"]) > 0) & (at["bytes"] + length(t) > most)
        carried = F.when(F.size(at["open"]) > 1, F.slice(at["open"], -1, 1)).otherwise(empty)
        opened = F.when(close, F.array_append(carried, t)).otherwise(F.array_append(at["open"], t))
        total = F.when(close, length(t) + F.aggregate(carried, F.lit(0), lambda s, x: s + length(x))).otherwise(at["bytes"] + length(t))
        done = F.when(close, F.array_append(at["done"], at["open"])).otherwise(at["done"])
        return F.struct(done.alias("done"), opened.alias("open"), total.alias("bytes"))

    zero = F.struct(F.array().cast("array<array<struct<text:string>>>").alias("done"), empty.alias("open"), F.lit(0).alias("bytes"))
    return F.aggregate(items, zero, step, lambda at: F.when(F.size(at["open"]) > 0, F.array_append(at["done"], at["open"])).otherwise(at["done"]))


def pages(texts: Column, most: int = 3200) -> Column:
    """Blocks packed into pages of at most ``most`` characters, a line feed between; a longer block is a page."""

    def step(at: Column, t: Column) -> Column:
        fits = (at["open"] == "") | (F.length(at["open"]) + 1 + F.length(t) <= most)
        joined = F.when(at["open"] == "", t).otherwise(F.concat(at["open"], F.lit("\n"), t))
        return F.struct(F.when(fits, at["done"]).otherwise(F.array_append(at["done"], at["open"])).alias("done"), F.when(fits, joined).otherwise(t).alias("open"))

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(texts, zero, step, lambda at: F.when(at["open"] != "", F.array_append(at["done"], at["open"])).otherwise(at["done"]))


def within_budget(rows: DataFrame, by: list[str], order: list[Column | str], cost: Column, budget: int) -> DataFrame:
    """Rows until the first whose running cost exceeds the budget; the first row always stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    running = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(w)
    costed = rows.withColumn("_over", (running > budget) & (nth > 1)).withColumn("_stop", F.max(F.col("_over").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return costed.filter("_stop = 0").drop("_over", "_stop")


def unrepeated(rows: DataFrame, by: list[str], order: list[Column | str], key: list[str]) -> DataFrame:
    """Rows that differ in ``key`` from the row before them; equal rows further apart stay."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_same", F.struct(*key).eqNullSafe(F.lag(F.struct(*key)).over(w))).filter("NOT _same").drop("_same")


def count_windows(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with window_no: every ``size`` rows of a key are one window."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("window_no", F.floor((F.row_number().over(w) - 1) / size))


def upserts(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The last version of each key, with the place of its first: an update doesn't move a row."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in key]), arrival)
    return rows.groupBy(*key).agg(F.min(arrival).alias("place"), last.alias("row")).select(*key, "place", "row.*")


def dominant_sources(frames: DataFrame, session: str, source: str, at_ms: str, level: str, window_ms: int = 50, least: float = 0.01, times: float = 2.0) -> DataFrame:
    """Of each session the source that is heard: among those within ``window_ms`` of the newest the only one, or the
    loudest if it has ``least`` and ``times`` the level of the second. ``frames``: one row a session and source.

    The newest time is a grouped maximum that is joined back, and the two loudest are found by a window limited to two.
    """
    newest = frames.groupBy(session).agg(F.max(at_ms).alias("_newest"))
    current = frames.join(newest, session).filter(F.col("_newest") - F.col(at_ms) <= window_ms).drop("_newest")
    w = Window.partitionBy(session).orderBy(F.desc(level), source)
    two = current.withColumn("_nth", F.row_number().over(w)).filter("_nth <= 2")
    best = two.groupBy(session).agg(F.min_by(F.struct(source, level), "_nth").alias("_best"), F.max(F.when(F.col("_nth") == 2, F.col(level))).alias("_second"))
    clear = F.col("_second").isNull() | ((F.col(f"_best.{level}") >= least) & (F.col(f"_best.{level}") >= F.col("_second") * times))
    return best.filter(clear).select(session, f"_best.{source}", f"_best.{level}")


def context_tail(rows: DataFrame, by: str, order: list[str], most: int = 1200, reset_ms: int = 30_000) -> DataFrame:
    """``rows`` (start_ms, end_ms, text) with context: the last ``most`` characters said before, from a word on.

    A pause of more than ``reset_ms`` forgets what was said. Texts of a run of rows without such a pause
    are gathered as far back as ``most`` rows, each of which brings a character at least, so a row's
    frame is bounded however long the run.
    """
    w = Window.partitionBy(by).orderBy(*order)
    run = F.sum((F.col("start_ms") - F.lag("end_ms").over(w) > reset_ms).cast("int")).over(w)
    said = rows.withColumn("_run", F.coalesce(run, F.lit(0))).withColumn("_said", F.when(F.trim("text") != "", F.right(F.trim("text"), F.lit(most + 1))))
    before = Window.partitionBy(by, "_run").orderBy(*order).rowsBetween(-most, -1)
    whole = F.array_join(F.collect_list("_said").over(before), " ")
    tail = F.when(F.length(whole) > most, F.regexp_replace(F.right(whole, F.lit(most)), r"^\S*\s", "")).otherwise(whole)
    return said.withColumn("context", tail).drop("_run", "_said")
