import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import feedback, index, ingest, jobs, listing, search, stats, tag_search, units
from shelfmark.sources.library import Library

T0 = dt.datetime(2024, 1, 15)
IMG = "image_id bigint, sha256 string, original_name string, storage_path string, thumbnail_path string, mime_type string, width int, height int, created_at timestamp, description string, tags_json string, reannotate_requested boolean"
VID = "video_id bigint, sha256 string, original_name string, storage_path string, mime_type string, duration_ms bigint, width int, height int, frame_count int, created_at timestamp, transcript_text string, transcript_updated_at timestamp, description string, tags_json string, annotation_updated_at timestamp, reannotate_requested boolean"
JOB = "job_id bigint, kind string, image_id bigint, video_id bigint, model_id bigint, state string, run_after timestamp, leased_until timestamp, lease_owner string, attempts int, max_attempts int, last_error string, created_at timestamp, updated_at timestamp"


class Tiny(Library):
    """A library of in-memory tables."""

    def __init__(self, spark, **tables):
        super().__init__(spark, "", 1)
        self.tables = tables

    def table(self, name):
        return self.tables[name]


def image(k, tags="[]", description="", name=None):
    return k, f"s{k}", name or f"i{k}.jpg", f"images/s{k}", None, "image/jpeg", 10, 20, T0, description, tags, False


def video(k, tags="[]", description="", transcript="", size=(100, 50)):
    return k, f"v{k}", f"v{k}.mp4", f"videos/v{k}", "video/mp4", 5000, *size, 2, T0, transcript, None, description, tags, None, False


def job(k, kind="embed_image", image_id=None, video_id=None, model=1, state="pending", run_after=None, leased_until=None, attempts=0, created=0):
    return k, kind, image_id, video_id, model, state, run_after, leased_until, None, attempts, 3, None, T0 + dt.timedelta(seconds=created), T0


@pytest.fixture(scope="module")
def lib(spark):
    images = [image(1, '["Cat","Dog"]'), image(2, '["cat"]', "two"), image(3, '["dog"," NSFW "]'), image(4, '["cat","dog"]'), image(5, "oops"), image(6, '["fox"]'), image(7, None)]
    videos = [video(1, '["clip"]', "clip one", "hello"), video(2, size=(0, 0)), video(3, '["nsfw"]')]
    frames = [(1, 4, 0, 0), (1, 2, 1, 1000), (2, 2, 0, 0), (3, 6, 0, 0)]
    vectors = {1: [1.0, 0.0], 2: [0.9, 0.1], 3: [0.8, 0.3], 4: [0.0, 1.0], 5: [0.0, 0.0], 6: [0.7, 0.7]}
    emb = [(k, 1, 2, v, T0) for k, v in vectors.items()] + [(1, 2, 2, [0.0, 9.0], T0), (7, 1, 1, [1.0], T0), (2, 1, 2, [5.0, 5.0], T0 - dt.timedelta(days=1)), (7, 1, 2, None, T0 - dt.timedelta(days=2))]
    return Tiny(
        spark,
        images=spark.createDataFrame(images, IMG),
        videos=spark.createDataFrame(videos, VID),
        video_frames=spark.createDataFrame(frames, "video_id bigint, image_id bigint, frame_index int, timestamp_ms bigint"),
        image_embeddings=spark.createDataFrame(emb, "image_id bigint, model_id bigint, dim int, vector array<float>, updated_at timestamp"),
        index_jobs=spark.createDataFrame([job(1, image_id=1, state="done"), job(2, image_id=2, state="failed", attempts=3), job(3, image_id=3, state="leased", leased_until=T0 - dt.timedelta(minutes=5)), job(4, image_id=4, created=-300), job(5, "annotate_image", image_id=1, state="done"), job(6, "annotate_video", video_id=1), job(7, image_id=6, model=2, state="failed")], JOB),
        embedding_models=spark.createDataFrame([(1, "m", "v1", 2, "cosine", True)], "model_id bigint, name string, version string, dimensions int, metric string, normalized boolean"),
    )


@pytest.fixture(autouse=True)
def two_dimensions(monkeypatch):
    plain = Library.embeddings
    monkeypatch.setattr(Library, "embeddings", lambda self, dim=2: plain(self, dim))


def query(spark, v):
    return spark.createDataFrame([(v,)], "query array<float>")


def seed(spark, k):
    return spark.createDataFrame([(k,)], "image_id bigint")


def test_only_current_vectors_of_the_model(lib):
    assert {r.image_id: list(r.vector)[0] for r in lib.embeddings().collect()}[2] == pytest.approx(0.9)
    assert lib.embeddings().count() == 6


def test_ranking_ties_and_zero_vectors(spark, lib):
    got = [(r.image_id, round(r.distance, 3)) for r in index.search(lib.embeddings(), query(spark, [1.0, 0.0]), 10).orderBy("rank").collect()]
    assert [g[0] for g in got] == [1, 2, 3, 6, 4, 5] and got[-1][1] == got[-2][1] == 1.0
    assert index.search(lib.embeddings(), query(spark, [1.0]), 10).count() == 0
    assert 1 not in {r.image_id for r in index.search_by_id(lib.embeddings(), seed(spark, 1), 10).collect()}
    assert index.search_by_id(lib.embeddings(), seed(spark, 99), 10).count() == 0
    assert [r.image_id for r in index.search_quantized(lib.embeddings(), query(spark, [1.0, 0.0]), 3).orderBy("rank").collect()] == [1, 2, 3]


def test_vector_index(spark, lib):
    ix = index.VectorIndex(lib.table("image_embeddings").where("image_id <= 3 and dim = 2"))
    new = spark.createDataFrame([(3, 1, 2, [1.0, 0.0], T0 + dt.timedelta(days=1)), (9, 1, 2, [1.0, 0.0], T0)], ix.rows.schema)
    after = ix.upsert(new)
    assert [r.image_id for r in after.search(1, [1.0, 0.0], 3).orderBy("rank").collect()] == [1, 3, 9]
    assert 3 not in {r.image_id for r in after.delete(seed(spark, 3).withColumn("model_id", F.lit(1).cast("bigint"))).search(1, [1.0, 0.0]).collect()}
    with pytest.raises(KeyError):
        after.search_by_image_id(2, 9)
    with pytest.raises(Exception, match="dimensions differ"):
        after.search(1, [1.0, 0.0, 0.0]).collect()


def test_enrich_repeats_images_but_not_videos(spark, lib):
    hits = spark.createDataFrame([(1, 1, 0.1), (2, 2, 0.2), (3, 1, 0.3), (4, 4, 0.4), (5, 77, 0.5)], "rank int, image_id bigint, distance double")
    got = units.enrich(lib, hits, True).orderBy("rank").collect()
    assert [(r.media_type, r.image_id, r.video_id, r.distance) for r in got] == [("image", 1, None, 0.1), ("video", 2, 1, 0.2), ("video", 2, 2, 0.2), ("image", 1, None, 0.3)]
    first, second = got[1], got[2]
    assert (first.description, first.tags, first.width, first.preview_path) == ("clip one", ["clip"], 100, "images/s2")
    assert (second.description, second.tags, second.width) == ("two", ["cat"], 10)


def test_similar_images(spark, lib):
    got = search.similar_images(lib, seed(spark, 2), 10, True).orderBy("rank").collect()
    assert got[0].is_anchor and got[0].video_id == 1
    assert all(r.video_id != 1 for r in got[1:]) and 2 not in {r.image_id for r in got[1:]}
    hidden = search.similar_images(lib, seed(spark, 1), 10).collect()
    assert {r.video_id for r in hidden} == {None, 1, 2} and 3 not in {r.image_id for r in hidden}
    assert len(search.similar_images(lib, seed(spark, 1), 2, True).collect()) == 2
    adult = search.similar_images(lib, seed(spark, 3), 10).collect()
    assert not any(r.is_anchor for r in adult) and 3 not in {r.image_id for r in adult}


def test_fusion(spark):
    schema = "rank int, media_type string, image_id bigint, video_id bigint, distance double, transcript_text string"
    frames = spark.createDataFrame([(1, "image", 1, None, 0.3, ""), (2, "video", 2, 1, 0.4, ""), (3, "video", 3, 2, 0.5, "")], schema)
    transcripts = spark.createDataFrame([(1, "video", 9, 2, 0.2, "b"), (2, "video", 8, 1, 0.4, "a")], schema)
    got = search.fuse(frames, transcripts).orderBy("rank").collect()
    assert [(r.media_type, r.image_id, r.transcript_text) for r in got] == [("video", 9, "b"), ("image", 1, ""), ("video", 2, "a")]


def test_transcripts_of_other_lengths_are_passed_over(spark, lib):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 0.0])], "video_id bigint, vector array<float>")
    got = search.transcript_search(lib, query(spark, [1.0, 0.0]), 5, False, vectors).collect()
    assert [(r.video_id, r.image_id) for r in got] == [(1, 4)]


def test_similar_videos(spark, lib):
    v1 = spark.createDataFrame([(1,)], "video_id bigint")
    got = search.similar_videos(lib, v1, include_adult=True).orderBy("rank").collect()
    assert {r.video_id for r in got} == {2, 3}
    assert {r.video_id for r in search.similar_videos(lib, v1, seen=[2], include_adult=True, liked=[2], skipped=[4]).collect()} == {3}
    assert {r.video_id for r in search.similar_videos(lib, v1).collect()} == {2}


def test_rerank_is_bounded_and_stable(spark):
    rows = [(1, 0.10, ["x"]), (2, 0.15, ["a", "b", "c"]), (3, 0.50, ["a", "b", "c"]), (4, 0.15, ["a", "b"])]
    df = spark.createDataFrame(rows, "rank int, distance double, tags array<string>").withColumn("id", F.col("rank"))
    assert [r.id for r in search.rerank(df, ["a", "b", "c"]).orderBy("rank").collect()] == [2, 4, 1, 3]
    assert [r.id for r in search.rerank(df).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_tag_search(lib):
    rows = lambda *a, **k: [(r.media_type, r.image_id, r.video_id, r.matched_count) for r in tag_search.tag_search(lib, *a, **k).orderBy("rank").collect()]
    assert rows(["cat", "dog"]) == [("image", 1, None, 2), ("video", 4, 1, 2), ("video", 2, 2, 1)]
    assert rows(["cat", "dog"], True) == [("image", 1, None, 2), ("video", 4, 1, 2)]
    assert len(rows(["dog"], include_adult=True)) == 3
    page = tag_search.tag_search(lib, ["cat", "dog"], limit=1, offset=1).collect()
    assert page[0].total == 3 and page[0]["rank"] == 2
    assert rows([]) == []


def test_tag_cloud_counts_units(lib):
    cloud = {r.tag: r["count"] for r in tag_search.tag_cloud(lib).collect()}
    assert cloud == {"cat": 3, "dog": 2}
    assert {r.tag for r in tag_search.tag_cloud(lib, prefix="d", include_adult=True).collect()} == {"dog"}


def test_lists(spark, lib):
    assert {r.image_id: r.index_state for r in listing.image_list(lib).collect()} == {1: "done", 5: "pending", 7: "pending"}
    states = {r.video_id: r.index_state for r in listing.video_list(lib, True).collect()}
    assert states == {1: "failed", 2: "failed", 3: "pending"}
    pages = [{r.image_id for r in listing.page(lib.images, "image_id", "random", 7, 3, o).collect()} for o in (0, 3, 6)]
    assert sum(map(len, pages)) == 7 and set.union(*pages) == set(range(1, 8))
    kept = listing.delete_videos(lib, spark.createDataFrame([(1,)], "video_id bigint"))
    assert {r.image_id for r in kept["images"].collect()} == {1, 2, 3, 5, 6, 7}
    assert kept["videos"].count() == 2 and kept["video_frames"].count() == 2
    assert {r.image_id for r in listing.delete_images(lib, lib.images.where("image_id in (1, 2)"))["images"].collect()} == {2, 3, 4, 5, 6, 7}
    toggled = {r.image_id: r.tags_json for r in listing.toggle_adult(lib.images, "image_id").collect()}
    assert toggled[2] == '["cat","nsfw"]' and toggled[3] == '["dog"]'


def test_statistics(lib):
    now = F.lit(T0)
    k = {r.kind: r for r in stats.kind_stats(lib, now).collect()}
    e = k["embed_image"]
    assert (e.tracked, e.runnable, e.pending, e.leased, e.done, e.failed, e.oldest_runnable_age_seconds) == (4, 2, 1, 1, 1, 1, 300)
    c = stats.library_counts(lib).collect()[0]
    assert (c.images_total, c.standalone_images_total, c.video_frame_images_total, c.tracked, c.missing, c.total, c.annotations_missing) == (7, 4, 3, 4, 3, 7, 1)
    assert [(r.job_id, r.original_name) for r in stats.recent_failures(lib).collect()] == [(2, "i2.jpg")]


def test_claiming(lib):
    now = F.lit(T0)
    chosen = jobs.claimable(lib.jobs, 1, now, 5).orderBy("rank").collect()
    assert [r.job_id for r in chosen] == [4, 3]
    after = {r.job_id: r for r in jobs.claim(lib.jobs, jobs.claimable(lib.jobs, 1, now, 1), "w", now).collect()}
    assert (after[4].state, after[4].attempts, after[4].lease_owner, after[4].leased_until) == ("leased", 1, "w", T0 + dt.timedelta(seconds=30))
    assert after[3].attempts == 0


def test_failing_and_retrying(spark, lib):
    now = F.lit(T0)
    errors = spark.createDataFrame([(2, "x"), (4, "y")], "job_id bigint, error string")
    after = {r.job_id: r for r in jobs.fail_or_retry(lib.jobs, errors, now).collect()}
    assert after[2].state == "failed" and after[4].state == "pending" and after[4].run_after == T0 + dt.timedelta(seconds=5)
    waits = spark.createDataFrame([(1,), (2,), (3,), (10,), (60,)], "a int").select(jobs.retry_delay(F.col("a"))).collect()
    assert [r[0] for r in waits] == [5, 10, 20, 300, 300]
    queue, more, counts = jobs.retry_failed(lib, now)
    requeued = sum(a.state != b.state for a, b in zip(lib.jobs.orderBy("job_id").collect(), jobs.requeue_unannotated(lib, now).orderBy("job_id").collect(), strict=True))
    assert tuple(counts.collect()[0]) == (lib.jobs.where("state = 'failed' and model_id = 1").count(), requeued + more.count())
    states = {r.job_id: r.state for r in queue.collect()}
    assert states[2] == "pending" and states[7] == "failed"
    assert {r.image_id for r in more.where("kind = 'embed_image'").collect()} == {5, 6, 7}


def test_a_chosen_seed_frame(spark, lib):
    video = spark.createDataFrame([(1,)], "video_id bigint")
    frames = [r.image_id for r in lib.frames.where("video_id = 1").orderBy("frame_index").collect()]
    stored = {r.image_id for r in lib.embeddings().collect()}
    for k in frames:
        if k in stored:
            assert [tuple(r) for r in search.seed_frame(lib, video, k).collect()] == [(k, 1)]
        else:
            with pytest.raises(KeyError):
                search.seed_frame(lib, video, k)
    with pytest.raises(ValueError, match="no frame"):
        search.seed_frame(lib, video, 99)


def test_the_commonest_tags_of_a_video(spark):
    from shelfmark.functions.models import summarize_videos

    rows = [(1, [("", ["zebra", "zebra"]), ("A red boat", ["boat", " Sea "]), ("Waves", ["sea", "sky", ""])]), (2, [(" ", ["x"])])]
    got = summarize_videos(spark.createDataFrame(rows, "video_id bigint, frames array<struct<description:string,tags:array<string>>>"), 2).collect()
    assert [(r.video_id, r.description, r.tags) for r in got] == [(1, "A red boat", ["sea", "boat"])]


def test_processing_goes_on_after_a_failure(lib):
    handler = lambda df: df.select("job_id", F.when(F.col("job_id") == 3, "boom").alias("error"))
    after = {r.job_id: r for r in jobs.process_batch(lib.jobs, {"embed_image": handler}, 1, F.lit(T0), 5).collect()}
    assert (after[4].state, after[3].state, after[3].last_error) == ("done", "pending", "boom")
    calls = lib.spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counting(job_id):
        calls.add(1)
        return "boom" if job_id == 3 else None

    jobs.process_batch(lib.jobs, {"embed_image": lambda df: df.select("job_id", counting("job_id").alias("error"))}, 1, F.lit(T0), 5).collect()
    assert calls.value == 2  # each claimed job once
    with pytest.raises(ValueError):
        jobs.process_batch(lib.jobs, {}, 1, F.lit(T0))


def test_models(lib):
    m = lib.table("embedding_models")
    assert jobs.register_model(m, "m", "v1", 2).count() == 1
    assert {r.model_id for r in jobs.register_model(m, "m", "v2", 2).collect()} == {1, 2}
    with pytest.raises(ValueError):
        jobs.register_model(m, "m", "v1", 3)


def test_feedback(spark):
    rows = [("s", k, 10 + k, tags, started, action, watch, dwell, ratio, T0, T0 + dt.timedelta(seconds=late)) for k, tags, started, action, watch, dwell, ratio, late in [
        (1, ["a", "b"], True, "ended", 1.0, 1.0, None, 0), (2, ["a"], True, "next", 100.0, 100.0, 0.1, 0), (3, None, True, "ended", 1.0, 1.0, 0.9, 0), (4, ["a"], False, "ended", 1.0, 1.0, 0.9, 0),
        (5, ["c", "C "], True, "close", 9.0, 9.0, 0.75, 0), (1, ["a", "b"], True, "ended", 1.0, 1.0, None, 60)]] + [("t", k, 1, ["x"], True, "ended", 1.0, 1.0, 1.0, T0, T0) for k in range(9)] + [("t", 9, 1, ["x"], True, "next", 1.0, 1.0, 0.0, T0, T0)]
    df = spark.createDataFrame(rows, "session_id string, seq int, image_id bigint, tags array<string>, playback_started boolean, action string, watch_ms double, dwell_ms double, completion_ratio double, observed_at timestamp, received_at timestamp")
    got = {(r.session_id, r.tag): r.score for r in feedback.tag_scores(df).collect()}
    assert got == {("s", "a"): 0.5, ("s", "b"): 1.0, ("s", "c"): 1.0, ("t", "x"): 4.5}
    assert {(r.tag, r.side) for r in feedback.preferences(feedback.tag_scores(df)).collect()} == {("a", "prefer"), ("b", "prefer"), ("c", "prefer"), ("x", "prefer")}
    ids = [(r["class"], r.image_id) for r in feedback.recent_ids(df).where("session_id = 's'").orderBy("class", "place").collect()]
    assert ids == [("positive", 11), ("positive", 13), ("positive", 15), ("soft_negative", 12)]
    assert feedback.decayed(feedback.tag_scores(df), 60).count() == 0
    assert [feedback.feed_page(*x) for x in ((0, 0), (4, 2), (4, 3))] == [4, 3, 0]


def test_ingest(spark, lib):
    files = spark.createDataFrame([(1, "s1", "x.jpg", "image/jpeg", 1, 1), (2, "new", "y.jpg", "image/jpeg", 1, 1), (3, "new", "z.jpg", "image/jpeg", 1, 1)], "upload_id bigint, digest string, original_name string, mime_type string, width int, height int")
    rows, more = ingest.ingest_images(lib.table("images"), lib.jobs, files, 1, F.lit(T0))
    assert [(r.image_id, r.original_name) for r in rows.collect()] == [(8, "y.jpg")]
    assert [r.image_id for r in more.collect()] == [8]
    vids = spark.createDataFrame([(1, "v1", "a", "video/mp4", 9, 1, 1), (2, "nv", "b", "video/mp4", 1000, 1, 1)], "upload_id bigint, digest string, original_name string, mime_type string, duration_ms bigint, width int, height int")
    new = ingest.ingest_videos(lib.table("videos"), vids, 1, F.lit(T0), 4)
    assert [(r.video_id, r.sha256) for r in new["videos"].collect()] == [(4, "nv")] and new["times"].count() == 4 and new["jobs"].count() == 2
    fr = spark.createDataFrame([(1, 4, 0, 125, "s1", 1, 1), (2, 4, 1, 375, "f1", 1, 1), (3, 4, 2, 625, "f1", 1, 1)], "upload_id bigint, video_id bigint, frame_index int, timestamp_ms bigint, digest string, width int, height int")
    got = ingest.ingest_frames(lib.table("images"), lib.jobs, fr, 1, F.lit(T0))
    assert [(r.frame_index, r.image_id) for r in got["video_frames"].orderBy("frame_index").collect()] == [(0, 1), (1, 8), (2, 8)] and got["images"].count() == 1
    times = ingest.sample_times(spark.createDataFrame([(1, 1000), (2, 0)], "video_id bigint, duration_ms bigint"), 4)
    assert [r.timestamp_ms for r in times.orderBy("video_id", "place").collect()] == [125, 375, 625, 875, 0, 0, 0, 0]
