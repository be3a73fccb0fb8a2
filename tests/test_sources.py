import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfmark.operators.ingest import sniffed_mime
from shelfmark.sources import media

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)
PNG += struct.pack(">I", zlib.crc32(PNG[12:]))
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00" + b"\x00" * 9 + b"\xff\xc0\x00\x11\x08\x00\x0a\x00\x14\x03" + b"\x00" * 9
WEBP = b"RIFF\x10\x00\x00\x00WEBPVP8 "
AVIF = struct.pack(">I", 28) + b"ftypmif1" + b"\x00" * 4 + b"miafavif" + b"\x00" * 4
MP4 = struct.pack(">I", 20) + b"ftypisom" + b"\x00" * 4 + b"mp41"
MOV = struct.pack(">I", 20) + b"ftypqt  " + b"\x00" * 4 + b"qt  "
WEBM = b"\x1aE\xdf\xa3" + b"\x00" * 8 + b"\x42\x82\x84webm"
KINDS = {"a.PNG": (PNG, "image/png"), "b.jpg": (JPEG, "image/jpeg"), "c.webp": (WEBP, "image/webp"), "d.avif": (AVIF, "image/avif"), "e.mp4": (MP4, "video/mp4"), "f.mov": (MOV, "video/quicktime"), "g.webm": (WEBM, "video/webm"), "h.jpeg": (b"", None), "i.gif": (b"GIF89a", "image/gif")}


def test_kinds_and_sizes(spark):
    df = spark.createDataFrame([(k, c) for k, (c, _) in KINDS.items()] + [("none", None)], "name string, content binary")
    got = {r.name: (r.m, r.d) for r in df.select("name", sniffed_mime(F.col("content")).alias("m"), media.dimensions("content").alias("d")).collect()}
    assert {k: got[k][0] for k in KINDS} == {k: m for k, (_, m) in KINDS.items()}
    assert tuple(got["a.PNG"][1]) == (7, 5) and tuple(got["b.jpg"][1]) == (20, 10) and tuple(got["c.webp"][1]) == (0, 0)
    assert tuple(got["h.jpeg"][1]) == (None, None)


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, (content, _) in KINDS.items():
        (tmp_path / "sub" / name).write_bytes(content)
    (tmp_path / "note.txt").write_text("no")
    rows = media.importable(media.directory(spark, str(tmp_path)), most_video=22).collect()
    assert {r.original_name for r in rows} == {"a.PNG", "b.jpg", "c.webp", "d.avif", "e.mp4", "f.mov", "g.webm"}
    assert {r.original_name for r in media.importable(media.directory(spark, str(tmp_path)), most_video=5).collect()} == {"a.PNG", "b.jpg", "c.webp", "d.avif"}


def test_vectors_round_trip(spark):
    v = [1.5, -2.25, 0.0]
    assert media.blob_to_floats(media.floats_to_blob(v)) == v and media.blob_to_floats(b"abc") is None
    df = spark.createDataFrame([(v,), (None,)], "v array<float>")
    back = df.select(media.decode_vectors(media.encode_vectors("v")).alias("v")).collect()
    assert np.allclose(back[0].v, v) and back[1].v is None
