import datetime as dt

from pyspark.sql import functions as F

from shelfmark.streaming.live import live_snapshots, worker_loop
from tests.test_operators import JOB, T0, job


def _ticks(spark, folder):
    spark.createDataFrame([(T0 + dt.timedelta(hours=1),)], "timestamp timestamp").write.mode("append").parquet(folder)
    return spark.readStream.schema("timestamp timestamp").parquet(folder)


def test_worker_loop(spark, tmp_path):
    state = [spark.createDataFrame([job(1, image_id=1), job(2, image_id=2)], JOB)]
    rows = {}

    def write(df, epoch):
        rows.update({r.job_id: r.state for r in df.collect()})

    handler = lambda df: df.select("job_id", F.lit(None).cast("string").alias("error"))
    q = worker_loop(_ticks(spark, str(tmp_path / "t")), lambda: state[0], write, {"embed_image": handler}, 1, str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert rows == {1: "done", 2: "done"}


def test_snapshots_are_pushed_once_while_unchanged(spark, tmp_path):
    pushed = []
    folder = str(tmp_path / "t")
    q = live_snapshots(_ticks(spark, folder), lambda: {"images": spark.range(2)}, lambda rows, epoch: pushed.append(rows), str(tmp_path / "c"), "100 milliseconds")
    q.processAllAvailable()
    _ticks(spark, folder)
    q.processAllAvailable()
    q.stop()
    assert pushed == [{"images": ['{"id":0}', '{"id":1}']}]


def test_session_scores_are_kept_between_triggers(spark, tmp_path):
    from shelfmark.streaming.live import session_scores

    schema = "session_id string, seq int, image_id bigint, tags array<string>, playback_started boolean, action string, watch_ms double, dwell_ms double, completion_ratio double, observed_at timestamp, received_at timestamp"
    row = lambda seq, tags, action, ratio: ("s", seq, 1, tags, True, action, 1.0, 1.0, ratio, T0, T0)
    folder = str(tmp_path / "t")
    spark.createDataFrame([row(1, ["A", "b"], "ended", 1.0), row(2, ["a"], "next", 0.1)], schema).coalesce(1).write.parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {}

    def keep(df, epoch):
        got.update({r.tag: r.score for r in df.collect()})

    try:
        stream = session_scores(spark.readStream.schema(schema).parquet(folder))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(keep).start()
        q.processAllAvailable()
        assert got == {"a": 0.5, "b": 1.0}
        spark.createDataFrame([row(3, ["b"], "ended", 1.0), row(1, ["A", "b"], "ended", 1.0)], schema).coalesce(1).write.mode("append").parquet(folder)
        q.processAllAvailable()
        q.stop()
        assert got == {"a": 0.5, "b": 2.0}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_staged_tables_can_be_cleared(spark):
    from shelfmark.runtime import clear, shared_dir, stage
    import os

    assert stage(spark.range(3), "x").count() == 3
    clear(spark)
    assert not os.path.isdir(f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")
