"""The indexing queue as pure transitions: current tables in, next tables out; ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage
from ..sources.library import Library

#: Kinds by priority.
KINDS = ("embed_image", "transcribe_video", "annotate_image", "annotate_video")
#: Longest wait before a retry, in seconds.
LONGEST_WAIT = 300


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def due(now: Column) -> Column:
    return F.col("run_after").isNull() | (F.col("run_after") <= now)


def runnable(now: Column) -> Column:
    """Due, and pending or leased with an expired lease."""
    expired = (F.col("state") == "leased") & F.col("leased_until").isNotNull() & (F.col("leased_until") <= now)
    return F.coalesce(due(now) & ((F.col("state") == "pending") | expired), F.lit(False))


def priority(kinds: tuple[str, ...] = KINDS) -> Column:
    place = F.lit(len(kinds))
    for k, kind in reversed(list(enumerate(kinds))):
        place = F.when(F.col("kind") == kind, k).otherwise(place)
    return place


def claimable(jobs: DataFrame, model_id: int, now: Column, n: int = 1, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The next ``n`` jobs of one kind: the first by kind, creation and id decides the kind."""
    mine = jobs.where((F.col("model_id") == model_id) & F.col("kind").isin(*kinds) & runnable(now))
    order = [priority(kinds), F.col("created_at"), F.col("job_id")]
    head = mine.orderBy(*order).limit(n)
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    first = F.first("kind").over(Window.orderBy("rank"))
    return ranked.withColumn("_first", first).where("kind = _first").drop("_first")


def claim(jobs: DataFrame, chosen: DataFrame, owner: str, now: Column, lease_seconds: int = 30) -> DataFrame:
    """The queue with the chosen jobs leased by ``owner`` and one more attempt on each."""
    marked = jobs.join(F.broadcast(chosen.select("job_id").distinct().withColumn("_mine", F.lit(True))), "job_id", "left")
    mine = F.col("_mine").isNotNull()
    put = lambda c, v: F.when(mine, v).otherwise(F.col(c))
    until = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))
    return marked.withColumns({"state": put("state", F.lit("leased")), "lease_owner": put("lease_owner", F.lit(owner)), "leased_until": put("leased_until", until), "attempts": put("attempts", F.col("attempts") + 1), "updated_at": put("updated_at", now)}).select(*jobs.columns)


def retry_delay(attempts: Column, base_seconds: int = 5) -> Column:
    """base * 2 ** (attempts - 1) seconds, five minutes at most; the base for a first attempt."""
    doubled = F.lit(base_seconds) * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(20)))
    return F.least(F.lit(LONGEST_WAIT), doubled).cast("int")


def fail_or_retry(jobs: DataFrame, errors: DataFrame, now: Column, base_seconds: int = 5) -> DataFrame:
    """The queue after ``errors`` (job_id, error): failed for good when the attempts are used up, else pending with a delay."""
    joined = jobs.join(errors.groupBy("job_id").agg(F.max("error").alias("_error")), "job_id", "left")
    hit, spent = F.col("_error").isNotNull(), F.col("attempts") >= F.col("max_attempts")
    later = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), retry_delay(F.col("attempts"), base_seconds))
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c))
    return joined.withColumns({"state": put("state", F.when(spent, "failed").otherwise("pending")), "run_after": put("run_after", F.when(spent, _null("timestamp")).otherwise(later)), "leased_until": put("leased_until", _null("timestamp")), "lease_owner": put("lease_owner", _null("string")), "last_error": put("last_error", F.col("_error")), "updated_at": put("updated_at", now)}).select(*jobs.columns)


def complete(jobs: DataFrame, finished: DataFrame, now: Column) -> DataFrame:
    """The queue with ``finished`` (job_id) done, lease and error cleared."""
    joined = jobs.join(finished.select("job_id").distinct().withColumn("_done", F.lit(True)), "job_id", "left")
    hit = F.col("_done").isNotNull()
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c))
    return joined.withColumns({"state": put("state", F.lit("done")), "leased_until": put("leased_until", _null("timestamp")), "lease_owner": put("lease_owner", _null("string")), "last_error": put("last_error", _null("string")), "updated_at": put("updated_at", now)}).select(*jobs.columns)


def store_annotations(media: DataFrame, key: str, results: DataFrame, now: Column) -> DataFrame:
    """Media with the descriptions and tags of ``results`` (key, new_description, new_tags); the request is cleared."""
    joined = media.join(results, key, "left")
    hit = F.col("new_tags").isNotNull()
    changes = {"description": F.when(hit, F.col("new_description")).otherwise(F.col("description")), "tags_json": F.when(hit, F.to_json("new_tags")).otherwise(F.col("tags_json")), "reannotate_requested": F.col("reannotate_requested") & ~hit}
    if "annotation_updated_at" in media.columns:
        changes["annotation_updated_at"] = F.when(hit, now).otherwise(F.col("annotation_updated_at"))
    return joined.withColumns(changes).select(*media.columns)


def store_transcripts(videos: DataFrame, vectors: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Videos and transcript vectors after ``results`` (video_id, new_text, vector); a blank text removes the vector."""
    joined = videos.join(results.select("video_id", "new_text"), "video_id", "left")
    hit = F.col("new_text").isNotNull()
    texts = joined.withColumn("transcript_text", F.when(hit, F.col("new_text")).otherwise(F.col("transcript_text"))).withColumn("transcript_updated_at", F.when(hit, now).otherwise(F.col("transcript_updated_at"))).select(*videos.columns)
    kept = vectors.join(results.select("video_id"), "video_id", "left_anti")
    return texts, kept.unionByName(results.where((F.trim("new_text") != "") & F.col("vector").isNotNull()).select("video_id", "vector"))


def no_audio(error: Column) -> Column:
    """Whether a transcriber's message says that there is nothing to hear."""
    return F.lower(error).rlike("no audio|does not contain any stream|matches no streams")


def image_tasks(lib: Library, jobs: DataFrame) -> DataFrame:
    """Jobs with their image's name and path, whether it lacks an annotation, and its first place in a video."""
    first = lib.frames.groupBy("image_id").agg(F.min(F.struct("video_id", "frame_index")).alias("at"))
    images = lib.images.select("image_id", "original_name", "storage_path", annotation_missing().alias("needs_annotation"), "reannotate_requested")
    return jobs.select("job_id", "kind", "image_id").join(images, "image_id").join(first, "image_id", "left").select("job_id", "kind", "image_id", "original_name", "storage_path", "needs_annotation", "reannotate_requested", F.col("at.video_id").alias("video_id"), F.col("at.frame_index").alias("frame_index"))


def video_inputs(lib: Library) -> DataFrame:
    """Per video its frames in order (index, image, description, tags), and the first one's path."""
    rows = lib.frames.join(lib.images.select("image_id", "storage_path", "description", "tags"), "image_id")
    frames = F.sort_array(F.collect_list(F.struct("frame_index", "image_id", "storage_path", "description", "tags")))
    return rows.groupBy("video_id").agg(frames.alias("frames")).withColumn("representative", F.col("frames")[0]["storage_path"])


def annotation_missing() -> Column:
    """A blank description or a tag list that is '' or '[]' by its text."""
    return (F.trim(F.coalesce("description", F.lit(""))) == "") | F.coalesce("tags_json", F.lit("")).isin("", "[]")


def _absent(jobs: DataFrame, wanted: DataFrame, key: str, kind: str, model_id: int) -> DataFrame:
    """``kind, image_id, video_id, model_id, state`` of the jobs that ``wanted`` needs and the queue lacks."""
    there = jobs.where((F.col("kind") == kind) & (F.col("model_id") == model_id) & F.col(key).isNotNull()).select(key)
    ids = wanted.select(key).distinct().join(there, key, "left_anti")
    other = "video_id" if key == "image_id" else "image_id"
    return ids.withColumns({other: _null("bigint"), "kind": F.lit(kind), "model_id": F.lit(model_id).cast("bigint"), "state": F.lit("pending")}).select("kind", "image_id", "video_id", "model_id", "state")


def missing_embed_jobs(lib: Library) -> DataFrame:
    return _absent(lib.jobs, lib.images, "image_id", "embed_image", lib.model_id)


def missing_annotate_jobs(lib: Library) -> DataFrame:
    return _absent(lib.jobs, lib.standalone(lib.images.where(annotation_missing())), "image_id", "annotate_image", lib.model_id)


def missing_transcribe_jobs(lib: Library) -> DataFrame:
    blank = F.trim(F.coalesce("transcript_text", F.lit(""))) == ""
    having = lib.transcript_embeddings().select("video_id").withColumn("_v", F.lit(1))
    return _absent(lib.jobs, lib.videos.join(having, "video_id", "left").where(blank | F.col("_v").isNull()), "video_id", "transcribe_video", lib.model_id)


def missing_annotate_video_jobs(lib: Library) -> DataFrame:
    return _absent(lib.jobs, lib.videos.where(annotation_missing()), "video_id", "annotate_video", lib.model_id)


def _reset(jobs: DataFrame, hit: Column, now: Column) -> DataFrame:
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c))
    return jobs.withColumns({"state": put("state", F.lit("pending")), "attempts": put("attempts", F.lit(0)), "run_after": put("run_after", _null("timestamp")), "leased_until": put("leased_until", _null("timestamp")), "lease_owner": put("lease_owner", _null("string")), "last_error": put("last_error", _null("string")), "updated_at": put("updated_at", now)})


def requeue_unannotated(lib: Library, now: Column, jobs: DataFrame | None = None) -> DataFrame:
    """The queue (``lib.jobs`` by default) with done annotate jobs of standalone images that still lack an annotation pending again."""
    jobs = lib.jobs if jobs is None else jobs
    joined, hit = _requeued(lib, jobs)
    return _reset(joined, hit, now).select(*jobs.columns)


def _requeued(lib: Library, jobs: DataFrame) -> tuple[DataFrame, Column]:
    lacking = lib.standalone(lib.images.where(annotation_missing())).select("image_id").distinct().withColumn("_lacks", F.lit(True))
    joined = jobs.join(lacking, "image_id", "left")
    return joined, (F.col("kind") == "annotate_image") & (F.col("model_id") == lib.model_id) & (F.col("state") == "done") & F.col("_lacks").isNotNull()


def retry_failed(lib: Library, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next queue, the missing jobs of all kinds, and one row ``retried, enqueued``.

    The model's failed jobs and its done annotate jobs that lack an annotation are pending again;
    ``enqueued`` counts the latter and the missing jobs.
    """
    hit = (F.col("model_id") == lib.model_id) & (F.col("state") == "failed")
    jobs = requeue_unannotated(lib, now, _reset(lib.jobs, hit, now))
    more = missing_embed_jobs(lib).unionByName(missing_annotate_jobs(lib)).unionByName(missing_annotate_video_jobs(lib)).unionByName(missing_transcribe_jobs(lib))
    joined, again = _requeued(lib, lib.jobs)
    changed = joined.agg(F.count_if(hit).alias("retried"), F.count_if(again).alias("requeued"))
    counts = changed.crossJoin(more.agg(F.count("*").alias("missing"))).select("retried", (F.col("requeued") + F.col("missing")).alias("enqueued"))  # one row each
    return jobs, more, counts


def request_reannotation(jobs: DataFrame, key: str, kind: str, model_id: int, items: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The queue with the annotate jobs of ``items`` reset unless leased, and the jobs they lack."""
    asked = items.select(key).distinct().withColumn("_asked", F.lit(True))
    joined = jobs.join(asked, key, "left")
    hit = (F.col("kind") == kind) & (F.col("model_id") == model_id) & F.col("_asked").isNotNull() & (F.col("state") != "leased")
    return _reset(joined, hit, now).select(*jobs.columns), _absent(jobs, items, key, kind, model_id)


def purge_models(rows: DataFrame, model_id: int) -> DataFrame:
    """Rows of the active model only."""
    return rows.where(F.col("model_id") == model_id)


def register_model(models: DataFrame, name: str, version: str, dimensions: int, metric: str = "cosine", normalized: bool = True) -> DataFrame:
    """The registry with the model; ValueError if it is there with another specification."""
    if dimensions <= 0:
        raise ValueError("dimensions must be positive")
    there = models.where((F.col("name") == name) & (F.col("version") == version)).limit(1).collect()
    if there:
        if (there[0].dimensions, there[0].metric, there[0].normalized) != (dimensions, metric, normalized):
            raise ValueError(f"model {name} {version} is registered differently")
        return models
    one = models.agg((F.coalesce(F.max("model_id"), F.lit(0)) + 1).alias("model_id")).select("model_id", F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(dimensions).alias("dimensions"), F.lit(metric).alias("metric"), F.lit(normalized).alias("normalized"))
    return models.unionByName(one)


def dispatch(claimed: DataFrame, handlers: dict) -> DataFrame:
    """``job_id, error`` of all claimed jobs: each kind goes to its handler (DataFrame to DataFrame of job_id, error); others fail."""
    known = [handlers[k](claimed.where(F.col("kind") == k)).select("job_id", "error") for k in handlers]
    out = claimed.where(~F.col("kind").isin(*handlers) if handlers else F.lit(True)).select("job_id", F.concat(F.lit("unsupported job kind "), "kind").alias("error"))
    for df in known:
        out = out.unionByName(df)
    return out


def process_batch(jobs: DataFrame, handlers: dict, model_id: int, now: Column, n: int = 1, owner: str = "worker", lease_seconds: int = 30) -> DataFrame:
    """Claim up to ``n`` jobs of one kind, run their handler, and give the next queue; a failed job does not stop the others."""
    if not handlers:
        raise ValueError("no handlers")
    # both are written, so that a job is chosen once and its handler runs once
    chosen = stage(claimable(jobs, model_id, now, n, tuple(k for k in KINDS if k in handlers)), "claimed")
    leased = claim(jobs, chosen, owner, now, lease_seconds)
    outcome = stage(dispatch(chosen, handlers), "outcome")
    return complete(fail_or_retry(leased, outcome.where("error is not null"), now), outcome.where("error is null"), now)
