"""Sound whose owner is announced beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def without_itself(rows: DataFrame, user: str, itself: object) -> DataFrame:
    """Rows but for those of the one who records; rows without a user stay."""
    return rows.filter(~F.col(user).eqNullSafe(F.lit(itself)))


def owned(frames: DataFrame, owners: DataFrame, lease_ms: int, delay: str = "10 seconds", itself: object | None = None) -> DataFrame:
    """(frame, ssrc, at, user_id): each frame of sound with whoever its stream was last announced to be, at its own time.

    ``frames``: frame, ssrc, at; ``owners``: ssrc, user_id, at, seq. An announcement holds for ``lease_ms``, and
    the later one counts, of one time that with the greater seq. Frames that nothing was announced for
    are dropped, as sound is never given to the wrong person; so is what ``itself`` says.

    The same over tables and over streams. Streams are joined, where both sides have watermarks: what is
    later than ``delay`` is dropped, and each side's rows are kept no longer than the lease and that delay.
    Tables are walked in the order of time, as a join makes a row for each frame and each announcement
    within the lease, which grows with the square of how dense they are.
    """
    f = frames.select("frame", "ssrc", "at")
    o = owners.select(F.col("ssrc").alias("_ssrc"), "user_id", F.col("at").alias("_since"), "seq")
    last = _joined(f, o, lease_ms, delay) if frames.isStreaming or owners.isStreaming else _walked(f, o, lease_ms)
    return without_itself(last, "user_id", itself) if itself is not None else last


def _joined(f: DataFrame, o: DataFrame, lease_ms: int, delay: str) -> DataFrame:
    held = (F.col("_ssrc") == F.col("ssrc")) & (F.col("_since") <= F.col("at")) & (F.col("_since") > F.col("at") - F.expr(f"INTERVAL {lease_ms} MILLISECONDS"))
    both = f.withWatermark("at", delay).join(o.withWatermark("_since", delay), held)
    return both.groupBy("at", "frame", "ssrc").agg(F.max_by("user_id", F.struct("_since", "seq")).alias("user_id"))


def _walked(f: DataFrame, o: DataFrame, lease_ms: int) -> DataFrame:
    """Slots of time as long as the lease: what holds for a frame was announced in its slot or in the one before.

    So each announcement is in two slots, and a stream's slot is sorted and walked once.
    """
    lease = F.lit(lease_ms * 1000)
    us = lambda at: F.unix_micros(F.col(at).cast("timestamp"))
    slot = F.col("_us") - F.pmod("_us", lease)
    told = o.select(F.col("_ssrc").alias("ssrc"), us("_since").alias("_us"), F.struct("user_id", us("_since").alias("us")).alias("_told"), F.struct(us("_since").alias("us"), "seq").alias("_nth"))
    told = told.select("*", F.explode(F.array(slot, slot + lease)).alias("_slot"))
    heard = f.select("ssrc", us("at").alias("_us"), "at", "frame", F.lit(True).alias("_heard")).withColumn("_slot", slot)
    rows = heard.unionByName(told, allowMissingColumns=True).filter("ssrc IS NOT NULL AND _us IS NOT NULL")
    # The frame of rows ends with all of the same time.
    so_far = Window.partitionBy("ssrc", "_slot").orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    walked = rows.withColumn("_told", F.max_by("_told", "_nth").over(so_far)).filter("_heard").filter(F.col("_told.us") > F.col("_us") - lease)
    # A frame sent twice counts once; its slot follows from its time, so nothing is shuffled again.
    return walked.groupBy("ssrc", "_slot", "at", "frame").agg(F.first("_told.user_id").alias("user_id")).select("at", "frame", "ssrc", "user_id")
