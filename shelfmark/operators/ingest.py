"""Taking files in: kinds of content, storing each content once, sampling frames, and what a batch came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import trimmed
from ..runtime import stage

IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp", "image/avif")
VIDEO_TYPES = ("video/mp4", "video/quicktime", "video/webm", "video/x-matroska")
#: Largest request, part kept in memory, files of a request, and largest video of an import.
MAX_BODY, MAX_MEMORY, MAX_FILES, MAX_VIDEO = 64 << 20, 8 << 20, 32, 20 << 20


def supported(mime: Column) -> Column:
    return mime.isin(*IMAGE_TYPES, *VIDEO_TYPES)


def sniffed_mime(content: Column) -> Column:
    """The type by the first bytes of a file; null if it is none that is known.

    RIFF/WEBP, AVIF by its main or compatible brands, QuickTime and MP4 by theirs, EBML as WebM or
    Matroska by its document type, else the usual magic numbers.
    """
    head = F.hex(F.substring(content, 1, 512))
    text = lambda s: s.encode().hex().upper()
    at = lambda offset, s: F.substring(head, 2 * offset + 1, 2 * len(s)) == text(s)
    brand = F.substring(head, 17, 8)
    size = F.conv(F.substring(head, 1, 8), 16, 10).cast("bigint")
    brands = F.regexp_replace(F.substring(head, 33, 1024), "(.{8})", "$1 ")
    listed = F.substring(brands, 1, F.greatest(F.lit(0), ((F.least(size, F.lit(512)) - 16) / 4).cast("int") * 9).cast("int"))
    ftyp = at(4, "ftyp")
    avif = ftyp & (brand.isin(text("avif"), text("avis")) | F.contains(listed, F.lit(text("avif"))) | F.contains(listed, F.lit(text("avis"))))
    mp4 = ftyp & (F.startswith(brand, F.lit(text("mp4"))) | F.startswith(brand, F.lit(text("iso"))) | brand.isin(text("M4V "), text("avc1")))
    ebml = F.startswith(head, F.lit("1A45DFA3"))
    return (
        F.when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg")
        .when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png")
        .when(at(0, "RIFF") & at(8, "WEBP"), "image/webp")
        .when(at(0, "GIF8"), "image/gif")
        .when(avif, "image/avif")
        .when(ftyp & (brand == text("qt  ")), "video/quicktime")
        .when(mp4, "video/mp4")
        .when(ebml & F.contains(head, F.lit(text("webm"))), "video/webm")
        .when(ebml & F.contains(head, F.lit(text("matroska"))), "video/x-matroska")
    )


def clean_digest(raw: Column) -> Column:
    """64 lower-case hex digits, a leading 'sha256:' and white space gone; null for all else."""
    found = F.regexp_extract(F.lower(trimmed(raw)), r"^(?:sha256:)?([0-9a-f]{64})$", 1)
    return F.when(found != "", found)


def store_once(files: DataFrame) -> DataFrame:
    """``upload_id, digest, stored_id, duplicate``: each content is stored under the first upload with its digest."""
    rows = files.select("upload_id", clean_digest(F.col("sha256")).alias("digest")).where("digest is not null")
    first = rows.groupBy("digest").agg(F.min("upload_id").alias("stored_id"))
    return rows.join(first, "digest").select("upload_id", "digest", "stored_id", (F.col("upload_id") != F.col("stored_id")).alias("duplicate"))


def batch_outcomes(uploads: DataFrame) -> DataFrame:
    """Per batch: files, created, duplicates, failed, and the status 400 all failed, 207 some, 200 all duplicates, else 201."""
    ok = F.col("status") == "ok"
    repeats = store_once(uploads.where(ok)).select("upload_id", "duplicate")
    rows = uploads.select("upload_id", "batch_no", ok.alias("ok")).join(repeats, "upload_id", "left").withColumn("dup", F.coalesce("duplicate", F.lit(False)))
    counts = rows.groupBy("batch_no").agg(F.count("*").alias("files"), F.count_if(F.col("ok") & ~F.col("dup")).alias("created"), F.count_if("dup").alias("duplicates"), F.count_if(~F.col("ok")).alias("failed"))
    status = F.when(F.col("failed") == F.col("files"), 400).when(F.col("failed") > 0, 207).when(F.col("duplicates") == F.col("files"), 200).otherwise(201)
    return counts.withColumn("http_status", status)


def new_contents(files: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per digest of ``files`` (digest, ...) that ``stored`` (sha256) lacks: the first by upload_id."""
    fresh = files.join(stored.select(F.col("sha256").alias("digest")), "digest", "left_anti")
    return fresh.groupBy("digest").agg(F.min_by(F.struct(*[c for c in files.columns if c != "digest"]), "upload_id").alias("f")).select("digest", "f.*")


def numbered(rows: DataFrame, order: str, start: int) -> DataFrame:
    """``rows`` with consecutive ``number`` from ``start`` in the order of a column, without gathering them in one task.

    The rows are range-partitioned and staged; the driver adds up one count per partition.
    """
    ranged = stage(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "numbered")
    offsets, at = [], start
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r._part, at))
        at += r["count"]
    sizes = rows.sparkSession.createDataFrame(offsets, "_part int, _offset bigint")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(sizes), "_part").withColumn("number", F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def ingest_images(images: DataFrame, jobs: DataFrame, files: DataFrame, model_id: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """New image rows and the embed jobs still missing, for ``files`` (upload_id, digest, original_name, mime_type, width, height).

    Ids follow the largest one; a known digest makes no new row but still gets a missing job.
    """
    top = images.agg(F.coalesce(F.max("image_id"), F.lit(0))).collect()[0][0]
    rows = numbered(new_contents(files, images), "upload_id", top + 1).withColumnRenamed("number", "image_id")
    rows = rows.select("image_id", F.col("digest").alias("sha256"), "original_name", F.concat(F.lit("images/"), "digest").alias("storage_path"), "mime_type", "width", "height", now.alias("created_at"), F.lit("").alias("description"), F.lit("[]").alias("tags_json"))
    known = images.join(files.select(F.col("digest").alias("sha256")), "sha256", "left_semi").select("image_id").unionByName(rows.select("image_id"))
    there = jobs.where((F.col("kind") == "embed_image") & (F.col("model_id") == model_id)).select("image_id")
    missing = known.join(there, "image_id", "left_anti").select(F.lit("embed_image").alias("kind"), "image_id", F.lit(model_id).cast("bigint").alias("model_id"), F.lit("pending").alias("state"))
    return rows, missing


def ingest_videos(videos: DataFrame, files: DataFrame, model_id: int, now: Column, frame_count: int = 10) -> dict[str, DataFrame]:
    """New video rows, the times of their frames, and their jobs, for ``files`` (upload_id, digest, original_name, mime_type, duration_ms, width, height).

    A known digest adds nothing at all.
    """
    top = videos.agg(F.coalesce(F.max("video_id"), F.lit(0))).collect()[0][0]
    rows = numbered(new_contents(files, videos), "upload_id", top + 1).withColumnRenamed("number", "video_id")
    new = rows.select("video_id", F.col("digest").alias("sha256"), "original_name", F.concat(F.lit("videos/"), "digest").alias("storage_path"), "mime_type", "duration_ms", "width", "height", F.lit(frame_count).alias("frame_count"), now.alias("created_at"), F.lit("").alias("transcript_text"), F.lit("").alias("description"), F.lit("[]").alias("tags_json"))
    kinds = F.explode(F.array(F.lit("transcribe_video"), F.lit("annotate_video"))).alias("kind")
    return {"videos": new, "times": sample_times(new.select("video_id", "duration_ms"), frame_count), "jobs": new.select(kinds, "video_id", F.lit(model_id).cast("bigint").alias("model_id"), F.lit("pending").alias("state"))}


def ingest_frames(images: DataFrame, jobs: DataFrame, frames: DataFrame, model_id: int, now: Column) -> dict[str, DataFrame]:
    """Image rows, embed jobs and frame rows for sampled ``frames`` (upload_id, video_id, frame_index, timestamp_ms, digest, width, height).

    A frame whose picture is stored already shares that image.
    """
    named = frames.withColumns({"original_name": F.concat(F.lit("frame_"), "frame_index", F.lit(".jpg")), "mime_type": F.lit("image/jpeg")})
    new, missing = ingest_images(images, jobs, named.select("upload_id", "digest", "original_name", "mime_type", "width", "height"), model_id, now)
    ids = images.select("image_id", F.col("sha256").alias("digest")).unionByName(new.select("image_id", F.col("sha256").alias("digest")))
    rows = frames.join(ids, "digest").select("video_id", "image_id", "frame_index", "timestamp_ms")
    return {"images": new, "jobs": missing, "video_frames": rows}


def sample_times(videos: DataFrame, n: int = 10) -> DataFrame:
    """``video_id, place, timestamp_ms``: ``n`` evenly spread times within each video; all 0 where the duration is not positive."""
    d = F.col("duration_ms")
    rows = videos.select("video_id", "duration_ms", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place"))
    time = F.round(d * (F.col("place") + 0.5) / n).cast("bigint")
    return rows.select("video_id", "place", F.greatest(F.lit(0), F.least(F.greatest(d - 1, F.lit(0)), time)).alias("timestamp_ms"))
