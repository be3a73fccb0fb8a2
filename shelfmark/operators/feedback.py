"""Session feedback: how a viewing counts, the tag scores of a session, and its preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the feedback model.
UP, DOWN, LOWEST, HIGHEST = 1.0, -0.5, -3.0, 5.0
DECAY, DROP, PREFERRED, MOST_TAGS, MOST_IDS = 0.9, 0.05, 0.25, 12, 8


def classify() -> Column:
    """'positive', 'soft_negative' or 'neutral' from playback_started, action, watch_ms, dwell_ms and completion_ratio."""
    ratio = F.coalesce("completion_ratio", F.lit(0.0))
    skipped = (F.col("action") == "next") & (F.col("watch_ms") < 3000) & (F.col("dwell_ms") < 3000) & (ratio < 0.2)
    return F.when(~F.coalesce("playback_started", F.lit(False)), "neutral").when((ratio >= 0.75) | (F.col("action") == "ended"), "positive").when(F.coalesce(skipped, F.lit(False)), "soft_negative").otherwise("neutral")


def deduplicated(interactions: DataFrame) -> DataFrame:
    """One row per (session_id, seq): rows that were sent again count once, as first received."""
    first = Window.partitionBy("session_id", "seq").orderBy("received_at", "observed_at")
    return interactions.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def clamped_fold(steps: Column) -> Column:
    """Score after ordered steps, each held between LOWEST and HIGHEST."""
    return F.aggregate(steps, F.lit(0.0), lambda s, x: F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), s + x)))


def tag_scores(interactions: DataFrame) -> DataFrame:
    """``session_id, tag, score``: +1 for each positive, -0.5 for each skipped viewing, clamped in the order of ``seq``.

    A viewing counts each of its distinct tags once; null tag lists count nothing.  The order
    matters because of the clamp, so a session's steps per tag are folded as an ordered list.
    """
    step = F.when(F.col("class") == "positive", UP).when(F.col("class") == "soft_negative", DOWN)
    rows = deduplicated(interactions).withColumn("class", classify()).select("session_id", "seq", "tags", step.alias("step")).where("step is not null")
    tag = F.explode(F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != ""))))
    rows = rows.select("session_id", "seq", "step", tag.alias("tag"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "step"))), lambda s: s["step"])
    return rows.groupBy("session_id", "tag").agg(ordered.alias("steps")).select("session_id", "tag", clamped_fold(F.col("steps")).alias("score"))


def decayed(scores: DataFrame, times: int = 1) -> DataFrame:
    """Scores after so many fetches; those that come near 0 are dropped."""
    return scores.withColumn("score", F.col("score") * DECAY**times).where(F.abs("score") >= DROP)


def preferences(scores: DataFrame) -> DataFrame:
    """``session_id, side, rank, tag, score``: up to 12 preferred and 12 avoided tags, strongest first, ties by name."""
    side = F.when(F.col("score") > 0, "prefer").otherwise("avoid")
    order = Window.partitionBy("session_id", "side").orderBy(F.abs("score").desc(), "tag")
    return scores.where(F.abs("score") >= PREFERRED).withColumn("side", side).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_TAGS).select("session_id", "side", "rank", "tag", "score")


def recent_ids(interactions: DataFrame) -> DataFrame:
    """``session_id, class, place, image_id``: the last 8 liked and skipped images, oldest first; an image's latest viewing decides its side."""
    rows = deduplicated(interactions).withColumn("class", classify()).where("class <> 'neutral'").select("session_id", "seq", "image_id", "class")
    latest = rows.groupBy("session_id", "image_id").agg(F.max(F.struct("seq", "class")).alias("m")).select("session_id", "image_id", "m.seq", "m.class")
    back = Window.partitionBy("session_id", "class").orderBy(F.desc("seq"), F.desc("image_id"))
    kept = latest.withColumn("back", F.row_number().over(back)).where(F.col("back") <= MOST_IDS)
    place = F.row_number().over(Window.partitionBy("session_id", "class").orderBy(F.desc("back")))
    return kept.withColumn("place", place).select("session_id", "class", "place", "image_id")


def feed_page(fetched: int, ahead: int, initial: int = 4, batch: int = 3, low: int = 2) -> int:
    """How many items a feed asks for next: the first page, a batch when few are ahead, else none."""
    return initial if fetched == 0 else batch if ahead <= low else 0
