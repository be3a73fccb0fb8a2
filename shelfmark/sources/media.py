"""Files of a folder as rows, and what their bytes say: type, digest, size in pixels, stored vectors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import MAX_VIDEO, VIDEO_TYPES, sniffed_mime, supported

EXTENSIONS = ("jpg", "jpeg", "png", "webp", "avif", "gif", "mp4", "mov", "webm", "mkv")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content`` of the media files of a folder and all below it, by extension in any case."""
    any_case = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in EXTENSIONS)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{any_case}}}").load(path)


def importable(files: DataFrame, most_video: int = MAX_VIDEO) -> DataFrame:
    """Files of a supported type with ``mime_type`` and ``sha256``; videos beyond ``most_video`` bytes are left out."""
    typed = files.withColumn("mime_type", sniffed_mime(F.col("content"))).where(supported(F.col("mime_type")))
    small = ~F.col("mime_type").isin(*VIDEO_TYPES) | (F.col("length") <= most_video)
    return typed.where(small).withColumn("sha256", F.sha2("content", 256)).withColumn("original_name", F.element_at(F.split("path", "/"), -1))


def served_mime(content: Column) -> Column:
    """The type a stored video is served with; null if it is no known container."""
    mime = sniffed_mime(content)
    return F.when(mime.isin(*VIDEO_TYPES), mime)


def image_size(content: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG or JPEG; (0, 0) for WebP and AVIF; null for anything else or broken headers."""
    b = content or b""
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", b[16:24]) if len(b) >= 24 and b[12:16] == b"IHDR" else None
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return 0, 0
    if b[4:8] == b"ftyp" and b[8:12] in (b"avif", b"avis"):
        return 0, 0
    if b[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def dimensions(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``image_size`` of each file; null fields where there is none."""
    for s in contents:
        sizes = [image_size(bytes(x)) if x is not None else None for x in s]
        yield pd.DataFrame({"width": pd.array([x[0] if x else None for x in sizes], "Int32"), "height": pd.array([x[1] if x else None for x in sizes], "Int32")})


def floats_to_blob(values) -> bytes:
    return np.asarray(values, "<f4").tobytes()


def blob_to_floats(blob: bytes | None) -> list[float] | None:
    """Little-endian float32 numbers; null for a blob whose length is no multiple of 4."""
    return None if blob is None or len(blob) % 4 else np.frombuffer(blob, "<f4").tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vectors(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in blobs:
        yield pd.Series([blob_to_floats(None if x is None else bytes(x)) for x in s], dtype=object)


@F.pandas_udf(T.BinaryType())
def encode_vectors(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in vectors:
        yield pd.Series([None if x is None else floats_to_blob(x) for x in s], dtype=object)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)
