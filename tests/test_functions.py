import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import audio, models, params
from shelfmark.functions import tags as T
from shelfmark.functions import text as X
from shelfmark.functions import vectors as V


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).collect()[0]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, None, None, None]
    with pytest.raises(Exception, match="dimensions differ"):
        df.select(V.cosine(F.col("a"), F.col("b"), True)).collect()


def test_vector_algebra_against_numpy(spark):
    rng = np.random.default_rng(0)
    q, n, m = (rng.standard_normal(16).astype("f4") for _ in range(3))
    r = one(spark, "q array<float>, n array<float>, m array<float>, z array<float>", (q.tolist(), n.tolist(), m.tolist(), [0.0] * 16), V.normalized(F.col("q")), V.without(F.col("q"), F.col("n")), V.without(F.col("q"), F.col("q")), V.normalized(F.col("z")), V.native_normalized(F.col("z")), V.feedback_query(F.col("q"), F.col("n"), F.col("m")), V.feedback_query(F.col("q"), F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")), V.feedback_query(F.col("z"), F.col("n"), F.col("m")))
    unit = q / np.linalg.norm(q)
    assert np.allclose(r[0], unit, atol=1e-6)
    d = q - n
    assert np.allclose(r[1], d / np.linalg.norm(d), atol=1e-6)
    assert np.allclose(r[2], q)
    assert r[3] is None and r[4] == [0.0] * 16
    delta = 0.35 * n.astype(float) - 0.15 * m
    delta *= min(1, 0.35 / np.linalg.norm(delta))
    moved = unit + delta
    assert np.allclose(r[5], moved / np.linalg.norm(moved), atol=1e-5)
    assert np.linalg.norm(r[5]) == pytest.approx(1, abs=1e-5)
    assert np.allclose(r[6], q) and r[7] == [0.0] * 16


def test_mean_skips_what_has_no_direction(spark):
    rows = [(1, [2.0, 0.0]), (1, [0.0, 3.0]), (1, [0.0, 0.0]), (1, [1.0, 1.0, 1.0]), (2, [0.0, 0.0])]
    got = V.mean_vector(spark.createDataFrame(rows, "k int, v array<float>"), ["k"], "v", 2).collect()
    assert [(r.k, r["mean"]) for r in got] == [(1, [0.5, 0.5])]


def test_tags(spark):
    t = ["", "bad", '["a", " NSFW\\u00a0", null]', "null", '["B","b "," "]', None, "{}"]
    df = spark.createDataFrame([(x,) for x in t], "j string").withColumn("t", T.decoded(F.col("j")))
    got = df.select("t", T.is_adult(F.col("t")), T.normalized_tags(F.col("t")), T.toggled(F.col("t"))).collect()
    assert [r[0] for r in got] == [[], [], ["a", " NSFW "], [], ["B", "b ", " "], [], []]
    assert [r[1] for r in got] == [False, False, True, False, False, False, False]
    assert got[4][2] == ["b"]
    assert (got[2][3].tags, got[2][3].present) == (["a"], False) and (got[4][3].tags, got[4][3].present) == (["B", "b", "nsfw"], True)
    with pytest.raises(Exception, match="no JSON list"):
        df.select(T.decoded(F.col("j"), strict=True)).collect()
    flagged = one(spark, "t array<string>", ([f"t{k}" for k in range(12)] + ["nsfw"],), T.with_adult_flag(F.col("t"), F.lit(True)), T.with_adult_flag(F.col("t"), F.lit(False)))
    assert flagged[0] == [f"t{k}" for k in range(9)] + ["nsfw"] and len(flagged[1]) == 12
    m = one(spark, "t array<string>", (["Cat ", "dog"],), T.matches(F.col("t"), ["cat", "dog"], True), T.matches(F.col("t"), ["cat", "x"], True), T.matches(F.col("t"), ["cat", "x"], False), T.matches(F.col("t"), [], True))
    assert list(m) == [True, False, True, True]


def test_text(spark):
    r = one(spark, "d string, n string", ("  A cat.  It sits.", "IMG_1234.jpg"), X.title(F.col("d"), F.col("n")), X.title(F.lit(" "), F.col("n")), X.title(F.lit(None), F.lit(None)), X.title(F.lit("x" * 300), F.col("n")), X.filename_hint(F.col("n")), X.filename_hint(F.lit("red_boat-at sea.png")), X.version_token(F.lit(" a b/c.gguf ")), X.version_token(F.lit("..")), X.duration_label(F.lit(125_900)), X.percent_label(F.lit(0.456)), X.plural(F.lit(1), "job"), X.plural(F.lit(2), "job"))
    assert list(r) == ["A cat.", "IMG_1234.jpg", "Untitled", "x" * 159 + "…", None, "red boat at sea", "a_b_c.gguf", "unknown", "2:05", "46%", "1 job", "2 jobs"]
    assert X.first_object('```json\n{"a": "}{", "b": {"c": 1}} tail') == '{"a": "}{", "b": {"c": 1}}'
    assert X.first_object("{broken {\"ok\": 1}") == '{"ok": 1}' and X.first_object(None) is None
    df = spark.createDataFrame([('x {"a": 1} y',), (None,)], "t string")
    assert [r[0] for r in df.select(X.json_object("t")).collect()] == ['{"a": 1}', None]


def test_params():
    assert [params.limit(x, 20) for x in (None, "x", "0", "201", "200", "7")] == [20, 20, 20, 20, 200, 7]
    assert [params.offset(x) for x in (None, "-1", "1000001", "30")] == [0, 0, 0, 30]
    assert params.cloud_limit("150") == 120 and params.min_count("1001") == 1
    assert [params.flag(x) for x in ("true", "1", "yes", None)] == [True, True, False, False]
    assert params.order("RANDOM", "newest") == "random" and params.order("best", "newest") == "newest"
    assert params.seed(str(2**63)) == 0 and params.seed("-5") == -5
    assert params.tag_filters([" A", "b"], "B,c") == ["a", "b", "c"] and params.tag_filters([], "", "q, r") == ["q", "r"]
    assert params.feedback_ids("3,x,3,-1,4", "4,5") == ([3, 4], [5])
    assert params.ids(",".join(map(str, range(1, 20)))) == list(range(1, 9))
    assert params.search_window(20, True) == 160 and params.search_window(100, True) == 200 and params.search_window(20, False) == 20
    assert [params.video_window(n, s) for n, s in ((1, 0), (40, 1), (200, 0))] == [256, 2568, 4000]
    assert params.item_id("/api/images/12", "/api/images/") == 12 and params.item_id("/api/images/12/x/", "/api/images/", "x") == 12
    assert params.item_id("/api/images/12/x", "/api/images/") is None and params.item_id("/api/images/0", "/api/images/") is None


def test_models(spark):
    df = spark.createDataFrame([(1, 10, "a_cat.jpg"), (2, 11, "")], "job_id bigint, image_id bigint, storage_path string")
    got = {r.job_id: r for r in models.embed_jobs(df, lambda: models.FakeEmbedder(8)).collect()}
    assert len(got[1].vector) == 8 and got[1].error is None and got[2].error
    a = df.select(models.annotate_udf(models.FakeAnnotator)("storage_path").alias("a"), models.transcribe_udf(models.FakeTranscriber)("storage_path").alias("t")).collect()[0]
    assert a.a.tags == ["a", "cat"] and a.t == "speech of a_cat.jpg"
    spark.udtf.register("sampler", models.sampler_udtf())
    assert [tuple(r) for r in spark.sql("SELECT * FROM sampler(1000, 4)").collect()] == [(0, 125), (1, 375), (2, 625), (3, 875)]


def test_audio():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(16_000).astype("f4")
    f = audio.features(x)
    assert f.shape[0] == audio.MELS and np.allclose(f[:, :100].mean(axis=1), 0, atol=1e-6)
    assert np.allclose(f[:, :100].std(axis=1, ddof=1), 1, atol=1e-2)
    assert np.allclose(audio.mel_to_hz(audio.hz_to_mel(np.array([100.0, 999, 4000]))), [100, 999, 4000])
    assert audio.features(np.zeros(0)).shape == (audio.MELS, 0)
    assert np.array_equal(audio.read_samples(x.tobytes()), x)
    for bad in (b"abc", np.array([np.nan], "<f4").tobytes()):
        with pytest.raises(ValueError):
            audio.read_samples(bad)
    assert audio.greedy_decode(np.eye(4)[[1, 1, 0, 2, 2, 0, 2]], 0) == [1, 2, 2]
    assert audio.join_tokens(["▁he", "llo", "▁you"]) == "hello you"
