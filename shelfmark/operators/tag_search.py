"""Search by exact tags and the tag cloud, over media units (a standalone image, or a video through its frames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import normalized_tags, size_class
from ..sources.library import Library
from .units import RESULT, image_fields, overlay, with_adult_flag


def _units(lib: Library, images: DataFrame, include_adult: bool) -> DataFrame:
    units = images.join(lib.frames.select("image_id", "video_id", "frame_index", "timestamp_ms"), "image_id", "left")
    if not include_adult:
        units = with_adult_flag(lib, units).where(~F.col("adult")).drop("adult")
    return units


def tag_search(lib: Library, wanted: list[str], match_all: bool = False, include_adult: bool = False, limit: int | None = 24, offset: int = 0) -> DataFrame:
    """Units with any or all of the normalized tags ``wanted``, most matching tags first.

    Each unit shows the image that matches best (the larger id on ties).  ``total`` counts all
    units, whatever the page; ``limit`` None gives every unit.  No tags, no rows.
    """
    hit = F.size(F.array_intersect(normalized_tags(F.col("image_tags")), F.array(*[F.lit(t) for t in wanted]).cast("array<string>")))
    need = len(wanted) if match_all else 1
    matched = image_fields(lib).withColumn("matched_count", hit).where(F.col("matched_count") >= max(need, 1))
    units = _units(lib, matched, include_adult)
    unit_id = F.coalesce("video_id", "image_id")
    per_unit = Window.partitionBy(F.col("video_id").isNull(), unit_id).orderBy(F.desc("matched_count"), F.desc("image_id"), "frame_index")
    best = units.withColumn("rn", F.row_number().over(per_unit)).where("rn = 1").drop("rn", "frame_index")
    results = overlay(lib, best).withColumn("distance", F.lit(0.0)).withColumn("search_source", F.lit("tag")).withColumn("unit_id", unit_id)
    order = [F.desc("matched_count"), F.desc("unit_id"), F.asc("media_type")]
    if limit is None:
        return results.select(*RESULT, "matched_count")
    total = best.agg(F.count("*").alias("total"))
    page = results.orderBy(*order).offset(offset).limit(limit)
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + offset)
    return ranked.crossJoin(F.broadcast(total)).select("rank", *RESULT, "matched_count", "total")


def unit_tags(lib: Library, include_adult: bool = False) -> DataFrame:
    """``is_video, unit_id, tag``: the distinct normalized tags of each unit's images."""
    units = _units(lib, lib.images.select("image_id", F.col("tags").alias("image_tags")), include_adult)
    exploded = units.select(F.col("video_id").isNotNull().alias("is_video"), F.coalesce("video_id", "image_id").alias("unit_id"), F.explode(normalized_tags(F.col("image_tags"))).alias("tag"))
    return exploded.distinct()


def tag_cloud(lib: Library, limit: int | None = 60, min_count: int = 1, prefix: str = "", include_adult: bool = False) -> DataFrame:
    """``tag, count, size_class``: in how many units each tag occurs, most frequent first, ties by name.

    ``prefix`` is a LIKE prefix: '%' and '_' in it are wildcards.  ``limit`` None gives all tags.
    """
    tags = unit_tags(lib, include_adult)
    if prefix:
        tags = tags.where(F.col("tag").like(prefix.replace("\\", "\\\\") + "%"))
    counted = tags.groupBy("tag").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)
    if limit is None:
        return counted
    page = counted.orderBy(F.desc("count"), "tag").limit(limit)
    whole = Window.partitionBy(F.lit(1))
    return page.withColumn("size_class", size_class(F.col("count"), F.min("count").over(whole), F.max("count").over(whole)))
