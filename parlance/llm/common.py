"""What several operators share: reading tables, the word pattern, and tables cut from their lineage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table called ``name`` in ``sf_dir``, read by Spark (any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model learns from: crc32 of the id as text is a multiple of 5. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset and Spark runs in this process alone, a folder of this machine is made; on a
    cluster that is an error, as executors don't share local folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage as checkpoint() does, so lost executors cost no recomputation, and Spark
    knows the size of what it reads back. The files stay until the cluster clears the folder of the
    application, or until freed() takes them away.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for tables in _open:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The tables written within each freed() that is open.
_open: list[list[str]] = []


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[list[str]]:
    """Frees the tables that written() makes within, at the end: the list of their paths, which may be changed.

    A freed table is empty afterwards, so nothing may still need its rows. Where the block fails all stay.
    """
    tables: list[str] = []
    _open.append(tables)
    try:
        yield tables
    finally:
        _open.remove(tables)
    for path in tables:
        spark.range(0).write.mode("overwrite").parquet(path)
