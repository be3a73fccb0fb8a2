"""Hits to results: what an image belongs to, whether it may be shown, and which fields it shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import is_adult
from ..sources.library import Library

RESULT = ("media_type", "image_id", "video_id", "distance", "original_name", "storage_path", "preview_path", "mime_type", "width", "height", "description", "tags", "timestamp_ms", "duration_ms", "transcript_text", "search_source")


def _frames_of(lib: Library, images: DataFrame) -> DataFrame:
    """``images`` (image_id, ...) with the video of each frame row; standalone images have a null video_id."""
    return images.join(lib.frames.select("image_id", "video_id", "frame_index", "timestamp_ms"), "image_id", "left")


def with_adult_flag(lib: Library, units: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Adds ``adult``: of a video if it or any frame is tagged, of a standalone image if it is.

    ``among`` (video_id) is the bounded list of the videos of ``units``, if there is one.
    """
    flagged = lib.adult_videos(among).withColumn("adult_video", F.lit(True))
    joined = units.join(flagged, "video_id", "left")
    own = is_adult(F.col("image_tags"))
    return joined.withColumn("adult", F.when(F.col("video_id").isNull(), own).otherwise(F.coalesce("adult_video", F.lit(False)))).drop("adult_video")


def overlay(lib: Library, units: DataFrame) -> DataFrame:
    """Fields of the video over those of its frame: names always, texts and tags if not blank, sizes if positive."""
    v = lib.videos.select(
        "video_id", F.col("original_name").alias("v_name"), F.col("storage_path").alias("v_path"), F.col("mime_type").alias("v_mime"), F.col("width").alias("v_width"), F.col("height").alias("v_height"),
        F.col("description").alias("v_description"), F.col("tags").alias("v_tags"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.coalesce("transcript_text", F.lit("")).alias("transcript_text"),
    )
    joined = units.join(v, "video_id", "left")
    video = F.col("video_id").isNotNull()
    choose = lambda good, theirs, own: F.when(video & good, F.col(theirs)).otherwise(F.col(own))
    return joined.select(
        *[c for c in units.columns if not c.startswith("image_") or c == "image_id"],
        F.when(video, "video").otherwise("image").alias("media_type"),
        choose(F.lit(True), "v_name", "image_name").alias("original_name"),
        choose(F.lit(True), "v_path", "image_path").alias("storage_path"),
        F.when(video, F.col("image_path")).otherwise("").alias("preview_path"),
        choose(F.lit(True), "v_mime", "image_mime").alias("mime_type"),
        choose(F.col("v_width") > 0, "v_width", "image_width").alias("width"),
        choose(F.col("v_height") > 0, "v_height", "image_height").alias("height"),
        choose(F.trim(F.coalesce("v_description", F.lit(""))) != "", "v_description", "image_description").alias("description"),
        choose(F.size("v_tags") > 0, "v_tags", "image_tags").alias("tags"),
        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
        F.coalesce("transcript_text", F.lit("")).alias("transcript_text"),
    )


def image_fields(lib: Library) -> DataFrame:
    return lib.images.select(
        "image_id", F.col("original_name").alias("image_name"), F.col("storage_path").alias("image_path"), F.col("mime_type").alias("image_mime"),
        F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.coalesce("description", F.lit("")).alias("image_description"), F.col("tags").alias("image_tags"),
    )


def enrich(lib: Library, hits: DataFrame, include_adult: bool) -> DataFrame:
    """Results of ``hits`` (rank, image_id, distance), ordered by a new ``rank``.

    Unknown images are dropped.  A standalone image may appear as often as it was hit, a video
    only at its first hit; of a frame shared by several videos the smaller video id comes first.
    ``hits`` is a top-k list, bounded by its window, so it is the side that is broadcast.
    """
    found = image_fields(lib).join(F.broadcast(hits), "image_id")
    videos = lib.frames.join(F.broadcast(hits.select("image_id")), "image_id", "left_semi").select("video_id").distinct()
    units = with_adult_flag(lib, _frames_of(lib, found), videos)
    if not include_adult:
        units = units.where(~F.col("adult"))
    first = Window.partitionBy("video_id", F.when(F.col("video_id").isNull(), F.col("rank"))).orderBy("rank", "frame_index")
    units = units.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "frame_index", "adult")
    results = overlay(lib, units).withColumn("search_source", F.lit(""))
    order = Window.orderBy("rank", F.coalesce("video_id", F.lit(0)))
    return results.select(F.row_number().over(order).alias("rank"), *RESULT)
