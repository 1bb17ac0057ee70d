"""Rosters as protobuf messages, base64 of them, and sound files: readers of bytes, and writers for the parts that are read."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Wire types, and the numbers of the fields in users, outputs and the messages around them.
NUMBER, EIGHT, BYTES, FOUR = 0, 1, 2, 5
USER_TEXT = {1: "device_id", 2: "full_name", 3: "picture", 7: "current", 21: "parent_device_id", 29: "display_name"}
USER_NUMBER = {4: "status", 34: "host"}
OUTPUT_TEXT, OUTPUT_TYPE, OUTPUT_STATUS = {4: "stream_id", 6: "device_id"}, 2, 10


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_T, _N, _B = T.StringType(), T.LongType(), T.BooleanType()
USERS = T.ArrayType(_struct(device_id=_T, full_name=_T, display_name=_T, picture=_T, status=_N, parent_device_id=_T, is_current=_B, is_host=_B))
OUTPUTS = T.ArrayType(_struct(device_id=_T, stream_id=_T, output_type=_N, disabled=_B))
FIELDS = T.ArrayType(_struct(number=_N, wire=T.IntegerType(), value=_N, data=T.BinaryType()))


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A varint and where it ends: 35 bits of it count, longer ones are read to their end."""
    end = at
    while end < len(data) - 1 and data[end] & 0x80:
        end += 1
    groups = data[at : min(end + 1, at + 5)]
    return sum((b & 0x7F) << 7 * i for i, b in enumerate(groups)), end + 1


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a message's fields in order; those cut off at the end are as long as what is there.

    A tag of 0 ends the message. Raises ValueError at a wire type that has no length.
    """
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        if not tag:
            return
        wire, size = tag & 7, 0
        if wire == NUMBER:
            value, at = _number(data, at)
        else:
            if wire == BYTES:
                size, at = _number(data, at)
            elif wire in (EIGHT, FOUR):
                size = 8 if wire == EIGHT else 4
            else:
                raise ValueError(f"wire type {wire}")
            value, at = data[at : at + size], at + size
        yield (tag & 0xFFFFFFFF) >> 3, wire, value


def _inside(data: bytes | None, *path: int) -> bytes | None:
    """The bytes of a field within a field and so on; of repeated ones the last."""
    for number in path:
        if data is None:
            return None
        data = next((v for v in reversed([v for n, wire, v in fields(data) if n == number and wire == BYTES])), None)
    return data


def _each(data: bytes, number: int) -> Iterator[bytes]:
    return (v for n, wire, v in fields(data) if n == number and wire == BYTES)


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def user_of(data: bytes) -> dict | None:
    """A user; None without a device. Empty pictures and parents are null."""
    got: dict = {}
    for number, wire, value in fields(data):
        if wire == BYTES and number in USER_TEXT:
            got[USER_TEXT[number]] = _text(value)
        elif wire == NUMBER and number in USER_NUMBER:
            got[USER_NUMBER[number]] = value
    if not got.get("device_id"):
        return None
    flags = {"is_current": bool(got.get("current")), "is_host": bool(got.get("host"))}
    return {"device_id": got["device_id"], "full_name": got.get("full_name", ""), "display_name": got.get("display_name", ""), "picture": got.get("picture") or None, "status": got.get("status", 0), "parent_device_id": got.get("parent_device_id") or None} | flags


def output_of(data: bytes) -> dict | None:
    """What a device sends; None without a device or a stream."""
    got: dict = {"output_type": 0, "disabled": False}
    for number, wire, value in fields(data):
        if wire == BYTES and number in OUTPUT_TEXT:
            got[OUTPUT_TEXT[number]] = _text(value)
        elif wire == NUMBER and number == OUTPUT_TYPE:
            got["output_type"] = value
        elif wire == BYTES and number == OUTPUT_STATUS:
            for n, w, v in fields(value):
                if n == 1 and w == NUMBER:
                    got["disabled"] = v != 0
    return got if got.get("device_id") and got.get("stream_id") else None


def users_of(data: bytes | None) -> list[dict]:
    return [u for u in map(user_of, _each(data, 2)) if u] if data is not None else []


def collection_of(data: bytes) -> dict:
    """The users and outputs of a message of the collection."""
    body = _inside(data, 1, 2)
    if body is None:
        return {"users": [], "outputs": []}
    outputs = [o for part in _each(body, 3) for o in map(output_of, _each(part, 2)) if o]
    return {"users": [u for part in _each(body, 13) for inner in _each(part, 1) for u in users_of(inner)], "outputs": outputs}


def _read(payload: pd.Series, reader) -> list:
    """What ``reader`` finds in each payload; None where it is null or broken."""

    def one(data: bytes | None):
        try:
            return None if data is None else reader(bytes(data))
        except ValueError:
            return None

    return [one(p) for p in payload]


@F.pandas_udf(FIELDS)
def protobuf_fields(payload: pd.Series) -> pd.Series:
    """All fields of a message, numbers in ``value`` and bytes in ``data``; null where it is null or broken."""

    def listed(data: bytes) -> list[dict]:
        return [{"number": n, "wire": w, "value": v if w == NUMBER else None, "data": None if w == NUMBER else v} for n, w, v in fields(data)]

    return pd.Series(_read(payload, listed), dtype=object)


@F.pandas_udf(_struct(users=USERS, outputs=OUTPUTS))
def roster(payload: pd.Series) -> pd.DataFrame:
    """Users and outputs of a collection message; both null where it is null or broken, both empty where it has no body."""
    return pd.DataFrame([r or {"users": None, "outputs": None} for r in _read(payload, collection_of)], columns=["users", "outputs"])


@F.pandas_udf(USERS)
def _first_users(payload: pd.Series) -> pd.Series:
    return pd.Series(_read(payload, lambda data: users_of(_inside(data, 2, 2))), dtype=object)


def first_roster(text: Column) -> Column:
    """The users of the base64 roster that a session begins with; null where it is null, no base64 or broken."""
    return _first_users(F.try_to_binary(F.trim(text), F.lit("base64")))


def _wav(data: bytes) -> list[float] | None:
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            body = data[at + 8 : at + 8 + size]
            return np.frombuffer(body[: len(body) // 4 * 4], "<f4").tolist()
        at += 8 + size + size % 2
    return None


@F.pandas_udf(T.ArrayType(T.FloatType()))
def wav_samples(data: pd.Series) -> pd.Series:
    """Samples of the first data chunk, wherever it is; null without one. Chunks of an odd size are padded."""
    return pd.Series(_read(data, _wav), dtype=object)


def _varint(n: Column) -> Column:
    group = lambda i, more: F.unhex(F.lpad(F.hex(F.shiftright(n, 7 * i).bitwiseAND(127) + more), 2, "0"))
    out = F.concat(*[group(i, 128) for i in range(4)], group(4, 0))
    for last in range(3, -1, -1):
        out = F.when(n < 1 << 7 * (last + 1), F.concat(*[group(i, 128) for i in range(last)], group(last, 0))).otherwise(out)
    return out


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that stands in the plan once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def number_bytes(n: Column) -> Column:
    """A number from 0 below 2^35 as a varint."""
    return _once(n.cast("long"), _varint)


def field_bytes(number: int, value: Column, is_number: bool = False) -> Column:
    """A field of a message; nothing where the value is null."""
    tag = number_bytes(F.lit(number * 8 + (NUMBER if is_number else BYTES)))
    if is_number:
        made = F.concat(tag, number_bytes(value))
    else:
        made = _once(value.cast("binary"), lambda data: F.concat(tag, number_bytes(F.octet_length(data)), data))
    return F.coalesce(made, F.unhex(F.lit("")))


def joined_bytes(parts: Column) -> Column:
    """The bytes of a list in one."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))
