"""Reading tables, and views of them as meetings, passages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(conversations: DataFrame) -> DataFrame:
    """(meeting_id, seq, speaker, start_ms, end_ms, text): a turn a second, as long in ms as its text in bytes."""
    return conversations.select(
        F.col("conv_id").alias("meeting_id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("speaker"),
        (F.col("turn") * 1000).alias("start_ms"),
        (F.col("turn") * 1000 + F.octet_length("text")).alias("end_ms"),
        "text",
    )


def links(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, key): the channel and the folder of each passage."""
    pairs = F.array(F.struct(F.lit("channel").alias("kind"), F.col("source").alias("key")), F.struct(F.lit("folder").alias("kind"), F.col("lang").alias("key")))
    return documents.select("doc_id", F.explode(pairs).alias("link")).select("doc_id", "link.kind", "link.key").filter("key IS NOT NULL")


def visible(labels: DataFrame) -> DataFrame:
    """Ids that the audience may see."""
    return labels.filter("quality = 1").select("doc_id").distinct()


def installed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes) of the files in a folder and those below it. Their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
