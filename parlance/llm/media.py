"""Media columns: bytes of texts as progressive JPEG files, and pictures as full-resolution RGB tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .arrow import flat, gather, mapped, pieces

#: Bytes of a block, which is also the unit of the padding.
BLOCK = 64


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, blocks of each): zeros are appended up to a positive multiple of 64."""
    n = np.diff(offsets)
    blocks = np.maximum(1, -(-n // BLOCK))
    out = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    filled = np.ones(len(out), bool)
    ends = np.cumsum(blocks) * BLOCK
    pad = blocks * BLOCK - n
    filled[gather(np.arange(len(out)), ends - pad, pad)] = False
    out[filled] = data
    return out, blocks


def encode_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and media, a progressive JPEG file that holds them losslessly.

    The bytes, padded with zeros to a positive multiple of 64, are the file's quantised coefficients (a
    unit of 8 bits each, steps of 1), so nothing is lost by the transform. Null counts as empty; an
    empty text is one block of zeros. Equal texts have equal files. A file grows with its text, to
    65,520 pixels each way; a longer text than that holds (6 GB) is beyond what a row can hold. Other
    columns are not used or returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            data, offsets = flat(batch.column("text"))
            files = jpeg.encode(*_padded(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """The rows of encode_media() with what their files hold.

    Scans are accumulated into coefficients, which are the ``payload``; those are inverse-transformed,
    chroma is upsampled, and the picture is stored as ``rgb``, the bytes of a height x width x 3 tensor.
    ``sums``: of its red, green and blue. All arithmetic is on whole numbers, so equal files have equal
    tensors whatever stands beside them. A null file gives nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", 3 << 20):
            files = batch.column("media").to_pylist()
            there = [i for i, f in enumerate(files) if f is not None]
            out: dict[str, list] = {c: [None] * len(files) for c in ("payload", "height", "width", "rgb", "sums")}
            if there:
                coefficients, heads = jpeg.decode([files[i] for i in there])
                blocks = jpeg.samples(coefficients, heads)
                for i, head in zip(there, heads, strict=True):
                    picture = jpeg.rgb(blocks, head)
                    out["payload"][i] = jpeg.payload(coefficients, head)
                    out["height"][i], out["width"][i] = picture.shape[:2]
                    out["rgb"][i] = picture.tobytes()
                    out["sums"][i] = picture.reshape(len(picture), -1).sum(0, dtype=np.uint32).reshape(-1, 3).sum(0, dtype=np.int64).tolist()
            kinds = {"payload": pa.binary(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary(), "sums": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_bytes", "media")), *(pa.array(v, kinds[c]) for c, v in out.items())], ["doc_id", "n_bytes", "media", *out])

    kind = media.schema["doc_id"].dataType.simpleString()
    return mapped(media.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, n_bytes long, media binary, payload binary, height int, width int, rgb binary, sums array<long>")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What the query returns: sizes and digests of what was stored and read back, and a feature of the picture."""
    read = decode_media(encode_media(docs, doc_id, text))
    feature = F.concat(F.concat_ws("x", "width", "height"), F.lit(":"), F.array_join(F.transform("sums", lambda s: F.round(s / (F.col("width") * F.col("height")), 3).cast("string")), ","), F.lit(":"), F.hex(F.crc32("rgb")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
