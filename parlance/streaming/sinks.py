"""Sinks that survive a retry: a batch that is sent again leaves what it left the first time.

Each batch has its own partition, which a repeated write replaces as a whole, and a ledger of the batches
that are through, so a batch that is known to be through is not written again. Between the write and the
ledger a failure costs a repeated write, never a second copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Write = Callable[[DataFrame, int], None]
#: Times as text, to the microsecond.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
LEDGER = "sink string, batch long"


def _there(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one before it is first written."""
    try:
        rows = spark.read.schema(schema).option("timestampFormat", STAMP).format(form).load(path)
        rows.schema  # noqa: B018  (the path is looked up here)
        return rows
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def write_batch(rows: DataFrame, batch: int, path: str, form: str = "parquet") -> None:
    """``rows`` as the partition of their batch, in the place of what was there."""
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("timestampFormat", STAMP).partitionBy("batch").format(form).save(path)


def through(spark: SparkSession, ledger: str, sink: str) -> DataFrame:
    """(batch) of the batches that a sink has been through with."""
    return _there(spark, ledger, LEDGER).filter(F.col("sink") == sink).select("batch").distinct()


def once(ledger: str, sink: str, write: Write) -> Write:
    """``write`` for foreachBatch: not at all for a batch that the ledger has, and put down in it afterwards."""

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if not through(spark, ledger, sink).filter(F.col("batch") == batch).isEmpty():
            return
        write(rows, batch)
        spark.createDataFrame([(sink, batch)], LEDGER).write.mode("append").parquet(ledger)

    return run


DOCUMENTS = "id long, version long, document string, batch long"
HEADERS = "id long, version long, header string, batch long"


def save_documents(path: str) -> Write:
    """Saves rows (id, version, document, header): documents first, headers when all of them are there.

    A document counts when its header does, so a failure in between leaves the one before it valid.
    """

    def write(rows: DataFrame, batch: int) -> None:
        write_batch(rows.select("id", "version", "document"), batch, f"{path}/documents")
        write_batch(rows.select("id", "version", "header"), batch, f"{path}/headers")

    return write


def saved_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, version, document, header): the latest version of each document that is wholly saved."""
    headers = _there(spark, f"{path}/headers", HEADERS)
    latest = headers.groupBy("id").agg(F.max_by(F.struct("version", "batch", "header"), F.struct("version", "batch")).alias("h")).select("id", "h.version", "h.batch", "h.header")
    documents = _there(spark, f"{path}/documents", DOCUMENTS)
    return latest.join(documents, ["id", "version", "batch"]).select("id", "version", "document", "header")


AUDIT = "schema_version int, id string, occurred_at timestamp, event string, guild_id string, channel_id string, participant_user_id string, participant_display_name string, notice_text string, detail string"
#: Events that carry no notice; all others do.
WITHOUT_NOTICE = ("kualiJoined", "participantJoined")


def audit_rows(rows: DataFrame, notice: str) -> DataFrame:
    """Audit records of rows (event_id, occurred_at, event, guild_id, channel_id, user_id, name, detail).

    An id is made from the event's own, so a row that is sent again is the same record; ids of guilds,
    channels and people are texts; all but the events of joining carry the notice.
    """
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        F.lit(1).alias("schema_version"),
        F.sha2(text("event_id"), 256).alias("id"),
        "occurred_at",
        "event",
        text("guild_id").alias("guild_id"),
        text("channel_id").alias("channel_id"),
        text("user_id").alias("participant_user_id"),
        F.col("name").alias("participant_display_name"),
        F.when(~F.col("event").isin(*WITHOUT_NOTICE), F.lit(notice)).alias("notice_text"),
        "detail",
    )


def append_audit(path: str, notice: str) -> Write:
    """A line of JSON for each row, in the order of time within a batch."""

    def write(rows: DataFrame, batch: int) -> None:
        write_batch(audit_rows(rows, notice).sortWithinPartitions("occurred_at", "id"), batch, path, "json")

    return write


def audit_trail(spark: SparkSession, path: str) -> DataFrame:
    return _there(spark, path, AUDIT + ", batch long", "json").drop("batch")


EMITTED = "seq long, event string, payload string"


def emit_events(path: str, event: str, columns: list[str], seq: str) -> Write:
    """Events for listeners: what happened, and its data as JSON without nulls."""

    def write(rows: DataFrame, batch: int) -> None:
        write_batch(rows.select(F.col(seq).cast("long").alias("seq"), F.col(event).alias("event"), F.to_json(F.struct(*columns)).alias("payload")), batch, path)

    return write


def emitted_events(spark: SparkSession, path: str) -> DataFrame:
    return _there(spark, path, EMITTED + ", batch long").drop("batch")


DONE = "id long, version long, outcome string, batch long"


def finish(path: str, work: Callable[[DataFrame], DataFrame]) -> Write:
    """Rows (id, version, document, header, ended) are saved; then what has ended is worked on, each by itself.

    ``work`` takes the saved rows (id, version, document, header) that have ended and weren't worked on in
    this version, and gives (id, version, outcome); an outcome that tells of a failure stops no other.
    All rows of a batch are saved before any is worked on, and a repeated batch works on the same again.
    """
    save = save_documents(path)

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        save(rows, batch)
        ended = rows.filter("ended").select("id").distinct()
        done = _there(spark, f"{path}/done", DONE).filter(F.col("batch") != batch).select("id", "version")
        ready = saved_documents(spark, path).join(ended, "id", "left_semi").join(done, ["id", "version"], "left_anti")
        write_batch(work(ready), batch, f"{path}/done")

    return write


def finished(spark: SparkSession, path: str) -> DataFrame:
    return _there(spark, f"{path}/done", DONE).select("id", "version", "outcome")
