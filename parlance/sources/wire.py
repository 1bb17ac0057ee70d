"""Decoders of live packets: audio frames, JSON events, compressed and base64 payloads."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = T.StructType([T.StructField("track", T.IntegerType()), T.StructField("ts_ms", T.DoubleType()), T.StructField("name", T.StringType()), T.StructField("samples", T.ArrayType(T.FloatType()))])
NAMED, MAGIC = 0x80000000, b"REC1"


def frame_of(data: bytes | None) -> tuple | None:
    """(track, ts_ms, name, samples) of a frame: track, time, a name if the track's high bit is set, padded to 4 bytes, then samples.

    Null where it is too short for what it says. Bytes after the last whole sample are dropped.
    """
    if data is None:
        return None
    data = bytes(data).removeprefix(MAGIC)
    if len(data) < 12:
        return None
    track, ts = struct.unpack_from("<Id", data)
    at, name = 12, None
    if track & NAMED:
        if len(data) < 16:
            return None
        (size,) = struct.unpack_from("<i", data, 12)
        if size < 0 or 16 + size > len(data):
            return None
        name = data[16 : 16 + size].decode("utf-8", "replace")
        at = 16 + (size + 3) // 4 * 4
    body = data[at:]
    return track & ~NAMED, ts, name, np.frombuffer(body[: len(body) // 4 * 4], "<f4").tolist()


def bytes_of(track: int, ts_ms: float, name: str | None, samples: list[float]) -> bytes:
    head = struct.pack("<Id", track | (NAMED if name is not None else 0), ts_ms)
    raw = (name or "").encode()
    named = struct.pack("<i", len(raw)) + raw + bytes(-len(raw) % 4) if name is not None else b""
    return head + named + np.asarray(samples, "<f4").tobytes()


@F.pandas_udf(FRAME)
def decode_frame(payload: pd.Series) -> pd.DataFrame:
    rows = [frame_of(p) or (None, None, None, None) for p in payload]
    return pd.DataFrame(rows, columns=[f.name for f in FRAME.fields])


@F.pandas_udf(T.BinaryType())
def inflated(payload: pd.Series) -> pd.Series:
    """Raw DEFLATE; null where it is broken. Spark has no such function."""

    def one(p: bytes | None) -> bytes | None:
        try:
            return None if p is None else zlib.decompress(p, -15)
        except zlib.error:
            return None

    return payload.map(one)


def event_of(text: Column) -> Column:
    """kind, ts, speaker and text of a JSON event; null without kind or ts."""
    e = F.from_json(text, "kind string, ts double, speaker string, text string", {"mode": "PERMISSIVE"})
    return F.when(e["kind"].isNotNull() & e["ts"].isNotNull(), e)


@F.pandas_udf(T.BinaryType())
def encode_frame(track: pd.Series, ts_ms: pd.Series, name: pd.Series, samples: pd.Series) -> pd.Series:
    """Packets of frames; a null name makes an unnamed one."""
    rows = zip(track.tolist(), ts_ms.tolist(), name.tolist(), samples.tolist(), strict=True)
    return pd.Series([bytes_of(int(k), float(at), None if pd.isna(n) else n, x) for k, at, n, x in rows])


@F.pandas_udf(T.BinaryType())
def deflated(data: pd.Series) -> pd.Series:
    """Raw DEFLATE, as inflated() reads it."""

    def one(x: bytes | None) -> bytes | None:
        if x is None:
            return None
        packer = zlib.compressobj(wbits=-15)
        return packer.compress(bytes(x)) + packer.flush()

    return data.map(one)


def delta_text(body: Column) -> Column:
    """(text, refused) of an event stream: the text of all deltas in order, and whether the answer was a refusal."""
    data = F.filter(F.split(body, r"\r?\n"), lambda line: F.startswith(line, F.lit("data:")))
    events = F.transform(data, lambda line: F.from_json(F.trim(F.substring(line, F.lit(6), F.length(line))), "type string, delta struct<type:string,text:string,stop_reason:string>"))
    text = F.array_join(F.transform(events, lambda e: e["delta"]["text"]), "")
    return F.struct(text.alias("text"), F.exists(events, lambda e: F.coalesce(e["delta"]["stop_reason"] == "refusal", F.lit(False))).alias("refused"))


def catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored catalog; an empty one where there is none or it can't be read."""
    try:
        found = spark.read.schema(schema).parquet(path)
        found.limit(1).count()
    except Exception as error:  # Spark reports a missing path and a broken file by many classes
        if not any(x in str(error) for x in ("PATH_NOT_FOUND", "CANNOT_READ", "FAILED_READ_FILE")):
            raise
        return spark.createDataFrame([], schema)
    return found
