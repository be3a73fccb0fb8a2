"""Structured Streaming forms: the worker loop, live snapshots, and session feedback as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.tags import plain
from ..operators import feedback
from ..operators.jobs import process_batch


def worker_loop(ticks: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], handlers: dict, model_id: int, checkpoint: str, n: int = 8, idle: str = "500 milliseconds") -> StreamingQuery:
    """Claim and process a batch at every trigger of ``ticks`` that has rows; ``read`` gives the queue, ``write`` puts its next state."""

    def step(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        now = F.lit(batch.agg(F.max("timestamp")).collect()[0][0])
        write(process_batch(read(), handlers, model_id, now, n), epoch)

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=idle).start()


def live_snapshots(ticks: DataFrame, snapshot: Callable[[], dict[str, DataFrame]], push: Callable[[dict[str, list[str]], int], None], checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Push the JSON rows of the snapshot's bounded pages whenever they differ from the last ones."""
    last: dict[str, list[str]] = {}

    def step(batch: DataFrame, epoch: int) -> None:
        nonlocal last
        now = {name: [r["j"] for r in df.select(F.to_json(F.struct("*")).alias("j")).collect()] for name, df in snapshot().items()}
        if now != last:
            push(now, epoch)
            last = now

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class _Scores(StatefulProcessor):
    """Tag scores of one session, folded as viewings arrive in order of seq within each batch."""

    def init(self, handle) -> None:
        self.scores = handle.getMapState("scores", "tag string", "score double")
        self.seen = handle.getMapState("seen", "seq int", "one boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        changed: dict[str, float] = {}
        for row in pd.concat(list(rows)).sort_values(["seq", "received_at"]).itertuples():
            if self.seen.containsKey((int(row.seq),)):
                continue
            self.seen.updateValue((int(row.seq),), (True,))
            for tag in dict.fromkeys(row.tags if row.tags is not None else []):
                old = changed.get(tag)
                if old is None:
                    old = self.scores.getValue((tag,))[0] if self.scores.containsKey((tag,)) else 0.0
                changed[tag] = max(feedback.LOWEST, min(feedback.HIGHEST, old + row.step))
        for tag, score in changed.items():
            self.scores.updateValue((tag,), (float(score),))
        if changed:
            yield pd.DataFrame({"session_id": [key[0]] * len(changed), "tag": list(changed), "score": list(changed.values())})

    def close(self) -> None:
        pass


def session_scores(interactions: DataFrame) -> DataFrame:
    """A stream of changed tag scores per session; rows sent again count once.

    Viewings of one session count in the order of ``seq`` within a trigger, and triggers in the
    order they run; the batch form is the reference where rows arrive late.
    """
    step = F.when(F.col("class") == "positive", feedback.UP).when(F.col("class") == "soft_negative", feedback.DOWN)
    tags = F.filter(F.transform("tags", plain), lambda t: t.isNotNull() & (t != ""))
    rows = interactions.withColumn("class", feedback.classify()).select("session_id", "seq", "received_at", tags.alias("tags"), step.alias("step")).where("step is not null")
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=_Scores(), outputStructType="session_id string, tag string, score double", outputMode="Update", timeMode="None")
