"""The search pipelines: each is one lazy plan from tables to ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import search_window, video_window
from ..functions.tags import matches, normalized_tags
from ..functions.vectors import feedback_query, mean_vector
from ..sources.library import Library
from .index import search, search_by_id
from .units import RESULT, enrich

#: Weight of one matching tag and bound of all, for the rerank of similar videos and of the client's buffer.
TAG_STEP, TAG_BOUND = 0.08, 0.12
BUFFER_STEP, BUFFER_BOUND = 0.02, 0.08


def _ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top(results: DataFrame, n: int) -> DataFrame:
    return results.where(F.col("rank") <= n)


def similar_images(lib: Library, seed: DataFrame, n: int = 20, include_adult: bool = False, window: int | None = None) -> DataFrame:
    """The seed's own result first (distance 0, ``is_anchor``), then its neighbours without the seed's unit, ``n`` rows at most.

    ``seed`` has one row with image_id.  A seed that may not be shown has no anchor row; then only
    the seed image itself is left out.  More hits are fetched than shown only where some may be
    dropped: adult ones are hidden, or the anchor is a video.
    """
    anchor = enrich(lib, seed.select(F.lit(1).alias("rank"), "image_id", F.lit(0.0).alias("distance")), include_adult).where("rank = 1")
    anchor = lib.spark.createDataFrame(anchor.collect(), anchor.schema)
    hits = search_by_id(lib.embeddings(), seed, window or search_window(n, not include_adult or anchor.where("media_type = 'video'").count() > 0))
    results = enrich(lib, hits, include_adult)
    unit = F.broadcast(anchor.select(F.col("video_id").alias("a_video"), F.col("image_id").alias("a_image")))
    hit = F.coalesce(F.col("video_id") == F.col("a_video"), F.lit(False)) | (F.col("video_id").isNull() & F.col("a_video").isNull() & (F.col("image_id") == F.col("a_image")))
    others = results.join(unit, hit, "left_anti").join(F.broadcast(seed.select(F.col("image_id").alias("seed_id"))), F.col("image_id") == F.col("seed_id"), "left_anti")
    both = anchor.withColumn("is_anchor", F.lit(True)).unionByName(others.withColumn("is_anchor", F.lit(False)))
    return top(_ranked(both, F.desc("is_anchor"), "rank"), n)


def transcript_search(lib: Library, query: DataFrame, n: int = 20, include_adult: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """Videos by the distance of their transcript's vector; vectors of another length are passed over.  The preview is the first frame."""
    vectors = lib.transcript_embeddings() if vectors is None else vectors
    if not include_adult:
        vectors = vectors.join(lib.adult_videos(), "video_id", "left_anti")
    best = search(vectors.select(F.col("video_id").alias("image_id"), "vector"), query, n).select(F.col("image_id").alias("video_id"), "distance")
    frames = lib.frames.join(F.broadcast(best.select("video_id")), "video_id", "left_semi")
    first = Window.partitionBy("video_id").orderBy("frame_index")
    preview = frames.join(lib.images.select("image_id", F.col("storage_path").alias("preview_path")), "image_id").withColumn("rn", F.row_number().over(first)).where("rn = 1").select("video_id", "image_id", "preview_path")
    v = lib.videos.join(F.broadcast(best), "video_id").join(preview, "video_id", "left")
    return _ranked(
        v.select(
            F.lit("video").alias("media_type"), F.coalesce("image_id", F.lit(0).cast("bigint")).alias("image_id"), "video_id", "distance", "original_name", "storage_path", F.coalesce("preview_path", F.lit("")).alias("preview_path"),
            "mime_type", "width", "height", F.coalesce("description", F.lit("")).alias("description"), "tags", F.lit(None).cast("bigint").alias("timestamp_ms"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.coalesce("transcript_text", F.lit("")).alias("transcript_text"), F.lit("").alias("search_source"),
        ),
        "distance", "video_id",
    ).select("rank", *RESULT)


def fuse(frames: DataFrame, transcripts: DataFrame, n: int | None = None) -> DataFrame:
    """One result per unit: the strictly nearer one, the frame's on ties; a frame result without a transcript takes that of the other."""
    both = frames.withColumn("src", F.lit(0)).unionByName(transcripts.withColumn("src", F.lit(1)))
    unit = F.when(F.col("media_type") == "video", F.concat(F.lit("video:"), "video_id")).otherwise(F.concat(F.lit("image:"), "image_id"))
    per_unit = Window.partitionBy("unit")
    both = both.withColumn("unit", unit).withColumn("rn", F.row_number().over(per_unit.orderBy("distance", "src", "rank")))
    other = F.max(F.when(F.col("src") == 1, F.col("transcript_text"))).over(per_unit)
    both = both.withColumn("transcript_text", F.when((F.col("src") == 0) & (F.col("transcript_text") == ""), F.coalesce(other, F.lit(""))).otherwise(F.col("transcript_text")))
    kept = both.where("rn = 1").drop("rn", "src", "unit")
    merged = _ranked(kept, "distance", "media_type", F.when(F.col("media_type") == "video", F.col("video_id")).otherwise(F.col("image_id")))
    return merged if n is None else top(merged, n)


def text_search(lib: Library, query: DataFrame, n: int = 20, required: list[str] = (), match_all: bool = True, include_adult: bool = False) -> DataFrame:
    """Frames and transcripts near the query vector, merged, filtered by the tags of the results, ``n`` at most.

    The window of hits is cut before the filters, so fewer than ``n`` results may remain.
    """
    window = search_window(n, bool(required) or not include_adult)
    frames = enrich(lib, search(lib.embeddings(), query, window), include_adult)
    merged = fuse(frames, transcript_search(lib, query, window, include_adult))
    return top(_ranked(merged.where(matches(F.col("tags"), list(required), match_all)), "rank"), n)


def seed_frame(lib: Library, video: DataFrame, image_id: int | None = None) -> DataFrame:
    """The first frame of the video (one row, video_id) that has a vector: ``image_id, seed_video``.

    With ``image_id`` that frame: ValueError if it is none of the video's, KeyError if it has no vector.
    """
    frames = lib.frames.join(F.broadcast(video.select("video_id")), "video_id")
    if image_id is not None:
        frames = frames.where(F.col("image_id") == image_id)
        if not frames.limit(1).count():
            raise ValueError(f"image {image_id} is no frame of the video")
        if not lib.embeddings().where(F.col("image_id") == image_id).limit(1).count():
            raise KeyError(image_id)
    having = frames.join(lib.embeddings().select("image_id"), "image_id", "left_semi")
    return having.orderBy("frame_index", "image_id").limit(1).select("image_id", F.col("video_id").alias("seed_video"))


def usable_feedback(lib: Library, ids: DataFrame, seed: DataFrame, seen: DataFrame) -> DataFrame:
    """``image_id, vector`` of those ``ids`` that are frames of seen videos and have a vector, the seed left out."""
    allowed = lib.frames.join(seen.select("video_id").distinct(), "video_id", "left_semi").select("image_id").distinct()
    chosen = ids.select("image_id").distinct().join(allowed, "image_id", "left_semi").join(seed.select("image_id"), "image_id", "left_anti")
    return lib.embeddings().join(chosen, "image_id", "left_semi")


def feedback_means(lib: Library, ids: DataFrame, seed: DataFrame, seen: DataFrame) -> DataFrame:
    """One row ``mean`` (null without usable ids) of the vectors that feedback names."""
    rows = usable_feedback(lib, ids, seed, seen).withColumn("one", F.lit(1))
    mean = mean_vector(rows, ["one"], "vector", 64)
    return ids.sparkSession.range(1).select(F.lit(1).alias("one")).join(mean, "one", "left").select("mean")


def similar_videos(lib: Library, video: DataFrame, n: int = 40, seen: list[int] = (), prefer: list[str] = (), avoid: list[str] = (), liked: list[int] = (), skipped: list[int] = (), include_adult: bool = False, seed_image: int | None = None) -> DataFrame:
    """Unseen videos near a video's seed frame, one result each, reranked by tags before the cut to ``n``."""
    spark = lib.spark
    seen_rows = spark.createDataFrame([(int(x),) for x in seen], "video_id bigint").unionByName(video.select("video_id"))
    seed = seed_frame(lib, video, seed_image)
    seed = spark.createDataFrame(seed.collect(), seed.schema)  # one row
    stored = lib.embeddings().join(F.broadcast(seed), "image_id").select(F.col("vector").alias("seed_vector"))
    query = stored.select(F.col("seed_vector").alias("query"))
    if liked or skipped:
        make = lambda ids: feedback_means(lib, spark.createDataFrame([(int(x),) for x in ids], "image_id bigint"), seed, seen_rows)
        both = stored.crossJoin(make(liked).withColumnRenamed("mean", "l")).crossJoin(make([x for x in skipped if x not in liked]).withColumnRenamed("mean", "s"))
        query = both.select(feedback_query(F.col("seed_vector"), F.col("l"), F.col("s")).alias("query"))
    others = lib.embeddings().join(F.broadcast(seed.select("image_id")), "image_id", "left_anti")
    hits = search(others, query, video_window(n, len(seen) + 1))
    results = enrich(lib, hits, include_adult).where("media_type = 'video'").join(F.broadcast(seen_rows.distinct()), "video_id", "left_anti")
    return top(rerank(results, prefer, avoid), n)


def rerank(results: DataFrame, prefer: list[str] = (), avoid: list[str] = ()) -> DataFrame:
    """Order by -distance plus a bounded nudge per preferred and avoided tag; unchanged without tags."""
    if not prefer and not avoid:
        return _ranked(results, "rank")
    count = lambda wanted: F.size(F.array_intersect(normalized_tags(F.col("tags")), F.array(*[F.lit(t) for t in wanted]).cast("array<string>")))
    nudge = (count(prefer) - count(avoid)) * TAG_STEP
    score = F.greatest(F.lit(-TAG_BOUND), F.least(F.lit(TAG_BOUND), nudge)) - F.col("distance")
    return _ranked(results, score.desc(), "distance", "rank")


def buffer_rerank(items: DataFrame, scores: DataFrame, current: int) -> DataFrame:
    """The client's buffer (position, image_id, distance, tags): items from ``current`` + 2 on are ordered by score, earlier ones stay.

    ``scores`` (tag, score) is a session's bounded set of tag scores.
    """
    later = items.where(F.col("position") >= current + 2)
    sums = later.select("position", F.explode(normalized_tags(F.col("tags"))).alias("tag")).join(F.broadcast(scores), "tag").groupBy("position").agg(F.sum("score").alias("s"))
    nudge = F.greatest(F.lit(-BUFFER_BOUND), F.least(F.lit(BUFFER_BOUND), F.coalesce("s", F.lit(0.0)) * BUFFER_STEP))
    value = nudge - F.coalesce("distance", F.col("position").cast("double"))
    moved = later.join(sums, "position", "left").withColumn("order", F.row_number().over(Window.orderBy(value.desc(), "position")) + current + 1).drop("s")
    return items.where(F.col("position") < current + 2).withColumn("order", F.col("position")).unionByName(moved)
