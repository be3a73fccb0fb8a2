"""Model interfaces: a pure Python object per worker behind an Arrow UDF, and deterministic stand-ins.

A model is given as a factory, so that it is loaded once per worker and not sent from the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FakeEmbedder:
    """Unit vectors drawn from the digest of a text or path: equal inputs, equal vectors."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, values: list[str]) -> list[np.ndarray | None]:
        out = []
        for v in values:
            if not v:
                out.append(None)
                continue
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "big"))
            x = rng.standard_normal(self.dim)
            out.append((x / np.linalg.norm(x)).astype("f4"))
        return out


class FakeAnnotator:
    """Description and tags from the words of a name."""

    def annotate(self, name: str, side_multiplier: int = 1) -> tuple[str, list[str], bool]:
        words = [w for w in name.rsplit(".", 1)[0].lower().replace("_", " ").replace("-", " ").split() if w.isalpha()]
        return f"A picture of {' '.join(words) or 'something'}.", words[:10], "nsfw" in words


class FakeTranscriber:
    def transcribe(self, path: str) -> str:
        return "" if "silent" in path else f"speech of {path.rsplit('/', 1)[-1]}"


def embed_udf(factory: Callable[[], object]):
    """pandas UDF text or path -> vector; null for inputs the model gives nothing for."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            yield pd.Series([None if v is None else v.tolist() for v in model.embed([x or "" for x in s])], dtype=object)

    return embed


def annotate_udf(factory: Callable[[], object], side_multiplier: int = 1):
    @F.pandas_udf("struct<description:string,tags:array<string>,is_adult:boolean>")
    def annotate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for s in batches:
            yield pd.DataFrame([model.annotate(x or "", side_multiplier) for x in s], columns=["description", "tags", "is_adult"])

    return annotate


def transcribe_udf(factory: Callable[[], object]):
    @F.pandas_udf("string")
    def transcribe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            yield s.map(lambda x: model.transcribe(x or ""))

    return transcribe


def embed_jobs(tasks: DataFrame, factory: Callable[[], object]) -> DataFrame:
    """``job_id, image_id, vector, error`` of embed tasks (job_id, image_id, storage_path): an empty vector is an error of its own job only."""
    vector = embed_udf(factory)(F.col("storage_path"))
    rows = tasks.select("job_id", "image_id", vector.alias("vector"))
    error = F.when(F.coalesce(F.size("vector"), F.lit(0)) <= 0, "model returned an empty vector")
    return rows.withColumn("error", error)


def summarize_videos(inputs: DataFrame, most_tags: int = 10, most_words: int = 40) -> DataFrame:
    """``video_id, description, tags``: a deterministic summary of ``video_inputs``: the first described frame and the commonest tags.

    Tags of equal count are taken in the order in which they appear; blank ones are passed over.
    Videos without a described frame have no row.
    """
    told = F.filter("frames", lambda f: F.trim(F.coalesce(f["description"], F.lit(""))) != "")
    rows = inputs.withColumn("told", told).where(F.size("told") > 0)
    rows = rows.withColumn("all", F.filter(F.flatten(F.transform("told", lambda f: F.transform(f["tags"], lambda t: F.lower(F.trim(t))))), lambda t: t != ""))
    counted = F.transform(F.array_distinct("all"), lambda t, k: F.struct(-F.size(F.filter("all", lambda x: x == t)), k, t.alias("tag")))
    tags = F.slice(F.transform(F.array_sort(counted), lambda c: c["tag"]), 1, most_tags)
    words = F.array_join(F.slice(F.split(F.col("told")[0]["description"], r"\s+"), 1, most_words), " ")
    return rows.select("video_id", words.alias("description"), tags.alias("tags"))


class UniformSampler:
    """Python table function (duration_ms, n) -> place, timestamp_ms: the times a frame sampler visits."""

    def eval(self, duration_ms: int, n: int):
        for k in range(n or 0):
            t = int(np.floor((duration_ms or 0) * (k + 0.5) / n + 0.5))
            yield k, max(0, min(max((duration_ms or 0) - 1, 0), t))


def sampler_udtf():
    return F.udtf(UniformSampler, returnType="place int, timestamp_ms bigint")
