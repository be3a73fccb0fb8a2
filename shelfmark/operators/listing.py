"""Lists of images and videos: state, order and pages; changes of single items as table transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import is_adult, toggled
from ..sources.library import Library

_MASK = (1 << 31) - 1


def shuffle_key(item: Column, seed: int) -> Column:
    """The key of a seeded shuffle: a masked linear congruential step, folded and stepped again."""
    # fixed values: multiplier and increment of the generator
    a, c = F.lit(1103515245).cast("bigint"), F.lit(12345).cast("bigint")
    mixed = (item * a + F.lit(seed & _MASK)).bitwiseAND(F.lit(_MASK))
    return ((mixed.bitwiseOR(F.shiftright(mixed, 16))) * a + c).bitwiseAND(F.lit(_MASK))


def page(df: DataFrame, key: str, order: str = "newest", seed: int = 0, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page with ``rank`` and the ``total`` of all rows; the shuffle keeps one order across pages."""
    by = [F.desc(key)] if order == "newest" else [shuffle_key(F.col(key), seed), F.col(key)]
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*by).offset(offset).limit(limit)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*by)) + offset).crossJoin(F.broadcast(total))


def image_list(lib: Library, include_adult: bool = False) -> DataFrame:
    """All standalone images with the state of their embed job, 'pending' where there is none."""
    rows = lib.standalone().where(F.lit(include_adult) | ~is_adult(F.col("tags")))
    jobs = lib.jobs.where((F.col("model_id") == lib.model_id) & (F.col("kind") == "embed_image")).select("image_id", F.col("state").alias("index_state"))
    return rows.join(jobs, "image_id", "left").withColumn("index_state", F.coalesce("index_state", F.lit("pending")))


def job_counts(jobs: DataFrame, key: str, prefix: str) -> DataFrame:
    """Failed, leased, done and all jobs per ``key``."""
    states = [F.count_if(F.col("state") == s).alias(f"{prefix}_{s}") for s in ("failed", "leased", "done")]
    return jobs.groupBy(key).agg(*states, F.count("job_id").alias(f"{prefix}_total"))


def video_list(lib: Library, include_adult: bool = False) -> DataFrame:
    """All videos with their preview frame and the state over frame, transcript and annotation jobs.

    One failed job makes the video failed, else one leased job leased; done needs at least one
    frame job and all jobs done; all else is pending.  Frames without a job do not count.
    """
    mine = lib.jobs.where(F.col("model_id") == lib.model_id)
    embed = mine.where("kind = 'embed_image'").select("image_id", "job_id", "state")
    frames = job_counts(lib.frames.select("video_id", "image_id").join(embed, "image_id"), "video_id", "f")
    transcripts = job_counts(mine.where("kind = 'transcribe_video' and video_id is not null"), "video_id", "t")
    annotations = job_counts(mine.where("kind = 'annotate_video' and video_id is not null"), "video_id", "a")
    first = lib.frames.groupBy("video_id").agg(F.min_by("image_id", F.struct("frame_index", "image_id")).alias("preview_image_id"))
    preview = first.join(lib.images.select(F.col("image_id").alias("preview_image_id"), F.col("storage_path").alias("preview_path")), "preview_image_id")
    rows = lib.videos if include_adult else lib.videos.join(lib.adult_videos(), "video_id", "left_anti")
    rows = rows.join(frames, "video_id", "left").join(transcripts, "video_id", "left").join(annotations, "video_id", "left").join(preview, "video_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    any_of = lambda s: (n(f"f_{s}") > 0) | (n(f"t_{s}") > 0) | (n(f"a_{s}") > 0)
    done = (n("f_total") > 0) & (n("f_done") == n("f_total")) & (n("t_done") == n("t_total")) & (n("a_done") == n("a_total"))
    state = F.when(any_of("failed"), "failed").when(any_of("leased"), "leased").when(done, "done").otherwise("pending")
    counts = [f"{p}_{s}" for p in "fta" for s in ("failed", "leased", "done", "total")]
    return rows.withColumn("index_state", state).withColumn("preview_image_id", F.coalesce("preview_image_id", F.lit(0).cast("bigint"))).withColumn("preview_path", F.coalesce("preview_path", F.lit(""))).drop(*counts)


def toggle_adult(media: DataFrame, key: str, item_id: int | None = None) -> DataFrame:
    """The table after switching the adult tag of one item, or of all: the tag list is rewritten as JSON."""
    chosen = F.lit(True) if item_id is None else F.col(key) == item_id
    return media.withColumn("tags_json", F.when(chosen, F.to_json(toggled(F.col("tags"))["tags"])).otherwise(F.col("tags_json")))


def reannotate(media: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """The table with description and tags of ``items`` cleared and the request set."""
    asked = items.select(key).distinct().withColumn("_asked", F.lit(True))
    now = F.col("_asked").isNotNull()
    changed = media.join(asked, key, "left")
    return changed.withColumn("description", F.when(now, "").otherwise(F.col("description"))).withColumn("tags_json", F.when(now, "[]").otherwise(F.col("tags_json"))).withColumn("reannotate_requested", now | F.col("reannotate_requested")).select(*media.columns)


def delete_images(lib: Library, items: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting standalone images with their vectors and jobs; frames of videos are refused and stay."""
    gone = items.select("image_id").join(lib.frames.select("image_id"), "image_id", "left_anti").distinct()
    keep = lambda name: lib.table(name).join(gone, "image_id", "left_anti")
    return {"images": keep("images"), "image_embeddings": keep("image_embeddings"), "index_jobs": keep("index_jobs")}


def orphan_frames(lib: Library, videos: DataFrame) -> DataFrame:
    """``image_id`` of frames of ``videos`` that no other video uses."""
    gone = lib.frames.join(videos.select("video_id").distinct().withColumn("_gone", F.lit(1)), "video_id", "left")
    return gone.groupBy("image_id").agg(F.count("*").alias("n"), F.count("_gone").alias("g")).where("g > 0 and n = g").select("image_id")


def delete_videos(lib: Library, videos: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting videos, their frames and jobs, and frame images that nothing else uses."""
    ids, images = videos.select("video_id").distinct(), orphan_frames(lib, videos)
    no_image = lambda name: lib.table(name).join(images, "image_id", "left_anti")
    return {
        "videos": lib.table("videos").join(ids, "video_id", "left_anti"),
        "video_frames": lib.frames.join(ids, "video_id", "left_anti"),
        "images": no_image("images"),
        "image_embeddings": no_image("image_embeddings"),
        "index_jobs": no_image("index_jobs").join(ids, "video_id", "left_anti"),
    }
