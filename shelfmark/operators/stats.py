"""Counts of the library and its queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.library import Library
from .jobs import annotation_missing, due, runnable


def kind_stats(lib: Library, now: Column) -> DataFrame:
    """Per kind of job: tracked, runnable, by state, and the age in seconds of the oldest runnable one."""
    seconds = lambda since: F.unix_seconds(now) - F.unix_seconds(since)
    waiting = (F.col("state") == "pending") & due(now)
    age = F.when(waiting, seconds(F.coalesce("run_after", "created_at"))).when(runnable(now), seconds(F.greatest("run_after", "leased_until"))).otherwise(0)
    rows = lib.jobs.where(F.col("model_id") == lib.model_id)
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("pending", "leased", "done", "failed")]
    return rows.groupBy("kind").agg(F.count("*").alias("tracked"), F.count_if(runnable(now)).alias("runnable"), *states, F.max(age).alias("oldest_runnable_age_seconds"))


def library_counts(lib: Library) -> DataFrame:
    """One row: images, standalone ones, frame images, videos, embed jobs tracked and missing, annotations missing."""
    images = lib.table("images").select("image_id").join(lib.frames.select("image_id").distinct().withColumn("_f", F.lit(1)), "image_id", "left")
    a = images.agg(F.count("*").alias("images_total"), F.count_if(F.col("_f").isNull()).alias("standalone_images_total"))
    v = lib.table("videos").agg(F.count("*").alias("videos_total"))
    mine = lib.jobs.where((F.col("model_id") == lib.model_id) & (F.col("kind") == "embed_image"))
    t = mine.agg(F.count("*").alias("tracked"))
    lacking = lib.standalone(lib.images.where(annotation_missing())).select("image_id")
    m = mine.where("state = 'done'").select("image_id").join(lacking, "image_id", "left_semi").agg(F.count("*").alias("annotations_missing"))
    one = a.crossJoin(v).crossJoin(t).crossJoin(m)
    floor = lambda x: F.greatest(x, F.lit(0))
    missing = floor(F.col("images_total") - F.col("tracked"))
    return one.withColumn("video_frame_images_total", floor(F.col("images_total") - F.col("standalone_images_total"))).withColumn("missing", missing).withColumn("total", F.col("tracked") + missing)


def recent_failures(lib: Library, n: int = 10) -> DataFrame:
    """The latest failed jobs of the model with the name of their image or video."""
    failed = lib.jobs.where((F.col("model_id") == lib.model_id) & (F.col("state") == "failed")).orderBy(F.desc("updated_at"), F.desc("job_id")).limit(n)
    failed = failed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("updated_at"), F.desc("job_id"))))
    images = lib.table("images").select("image_id", F.col("original_name").alias("image_name"))
    videos = lib.table("videos").select("video_id", F.col("original_name").alias("video_name"))
    named = images.join(F.broadcast(failed), "image_id", "right").join(videos, "video_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return named.select("rank", "job_id", "kind", F.when(F.col("video_id").isNotNull(), "video").otherwise("image").alias("media_type"), zero("image_id"), zero("video_id"), F.coalesce("image_name", "video_name", F.lit("")).alias("original_name"), "attempts", F.coalesce("last_error", F.lit("")).alias("last_error"), "updated_at")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, change`` of items that were added, removed or changed between two snapshots."""
    printed = lambda df, name: df.select(key, F.xxhash64(*[F.col(c).cast("string") for c in columns]).alias(name))
    both = printed(before, "x").join(printed(after, "y"), key, "full")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select(key, change.alias("change"))
