"""Exact and approximate nearest neighbours of a query vector, and the state of the index as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import normalized


@dataclass
class SearchDebug:
    """What a search did: the backend, its strategy, and whether copies of reduced precision were used."""

    backend: str = "spark"
    strategy: str = "exact"
    quantized: bool | None = None


#: A hit list up to this size comes to the driver, which makes it a small table of its own.
SMALL_LIST = 10_000
_HIT = "rank int, image_id bigint, distance double"


def _nearest(query: np.ndarray, k: int, strict: bool):
    """Columns in: image_id, vector; out: the ``k`` nearest rows of a task, by distance and id."""
    norm = float(np.sqrt((query * query).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, distances = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            vectors = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            if strict and ((lengths >= 0) & (lengths != len(query))).any():
                raise ValueError("vector dimensions differ")
            fits = np.flatnonzero((lengths == len(query)) & (len(query) > 0))
            if not len(fits):
                continue
            rows = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
            size = np.sqrt((rows * rows).sum(axis=1)) * norm
            # sums row by row, so that equal vectors have equal distances
            distance = 1 - np.divide((rows * query).sum(axis=1), size, out=np.zeros(len(fits)), where=size > 0)
            good = ~np.isnan(rows).any(axis=1)
            ids = np.concatenate([ids, batch.column(0).to_numpy(zero_copy_only=False)[fits][good].astype(np.int64)])
            distances = np.concatenate([distances, distance[good]])
            if len(ids) > k:
                best = np.lexsort((ids, distances))[:k]
                ids, distances = ids[best], distances[best]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(distances)], names=["image_id", "distance"])

    return run


def search(embeddings: DataFrame, query: DataFrame, k: int = 20, strict: bool = False) -> DataFrame:
    """``rank, image_id, distance`` of the ``k`` nearest rows of ``embeddings`` (image_id, vector).

    ``query`` has one row with the column ``query``, which is read here and sent to the tasks; each
    scores its rows batch by batch and keeps its own best k.  Ties go to the smaller id.  Rows that
    cannot be compared (null, of another length, or with nulls or NaN) are passed over; other
    lengths raise an error with ``strict``.  No query row, no hits.
    """
    spark = embeddings.sparkSession
    rows = query.select("query").limit(1).collect()
    if not rows or rows[0].query is None or k <= 0:
        return spark.createDataFrame([], _HIT)
    vector = np.array([np.nan if x is None else x for x in rows[0].query], np.float64)
    near = embeddings.select(F.col("image_id").cast("bigint"), "vector").mapInArrow(_nearest(vector, k, strict), "image_id bigint, distance double")
    best = near.orderBy("distance", "image_id").limit(k)
    if k > SMALL_LIST:
        return best.select(F.row_number().over(Window.orderBy("distance", "image_id")).alias("rank"), "image_id", "distance")
    return spark.createDataFrame([(n + 1, r.image_id, r.distance) for n, r in enumerate(best.collect())], _HIT)


def search_by_id(embeddings: DataFrame, seed: DataFrame, k: int = 20) -> DataFrame:
    """Neighbours of the stored vector of ``seed`` (one row, image_id), itself left out; none if it is not stored."""
    rows = seed.select("image_id").limit(1).collect()
    if not rows or rows[0].image_id is None:
        return seed.sparkSession.createDataFrame([], _HIT)
    mine = F.col("image_id") == rows[0].image_id
    return search(embeddings.where(~mine), embeddings.where(mine).select(F.col("vector").alias("query")), k)


def quantized(embeddings: DataFrame) -> DataFrame:
    """``image_id, code, step``: 8-bit copies of the unit vectors."""
    unit = embeddings.select("image_id", normalized(F.col("vector")).alias("u")).where("u is not null")
    step = F.array_max(F.transform("u", F.abs)) / 127
    return unit.select("image_id", F.transform("u", lambda x: F.round(x / step).cast("tinyint")).alias("code"), step.cast("float").alias("step"))


def search_quantized(embeddings: DataFrame, query: DataFrame, k: int = 20, widen: int = 4) -> DataFrame:
    """Scan of the 8-bit copies for ``widen * k`` candidates, reranked exactly.

    The caller keeps ``quantized(embeddings)`` in a table where it pays; here it is derived.
    """
    codes = quantized(embeddings).select("image_id", F.col("code").alias("vector"))
    candidates = search(codes, query, k * widen).select("image_id")
    return search(embeddings.join(F.broadcast(candidates), "image_id", "left_semi"), query, k)


def search_with(strategy: str, embeddings: DataFrame, query: DataFrame, k: int = 20) -> tuple[DataFrame, SearchDebug]:
    if strategy == "int8":
        return search_quantized(embeddings, query, k), SearchDebug(strategy="int8", quantized=True)
    if strategy == "exact":
        return search(embeddings, query, k), SearchDebug(quantized=False)
    raise ValueError(f"unknown strategy {strategy!r}")


def counts(rows: DataFrame, model_id: int) -> DataFrame:
    """One row: ``model_rows, all_rows, newest`` of an embeddings table, in one pass; tells whether a derived copy is stale."""
    mine = F.col("model_id") == model_id
    return rows.agg(F.count_if(mine).alias("model_rows"), F.count("*").alias("all_rows"), F.max(F.when(mine, F.col("updated_at"))).alias("newest"))


def upsert(rows: DataFrame, new: DataFrame, key: tuple[str, ...] = ("image_id", "model_id")) -> DataFrame:
    """The table with ``new`` rows in place of those of the same key; of several new ones the latest."""
    order = Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc("updated_at"))
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_new")


def delete(rows: DataFrame, keys: DataFrame, key: tuple[str, ...] = ("image_id", "model_id")) -> DataFrame:
    return rows.join(keys.select(*key).distinct(), list(key), "left_anti").select(*rows.columns)


def check_dimensions(rows: DataFrame, dim: Column | int) -> DataFrame:
    """Rows whose vector has not the declared length."""
    return rows.where(F.col("vector").isNull() | (F.size("vector") != dim))


class VectorIndex:
    """The index interface over a table of (image_id, model_id, dim, vector, updated_at); changes give a new index."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def upsert(self, new: DataFrame) -> VectorIndex:
        return VectorIndex(upsert(self.rows, new.withColumn("dim", F.size("vector"))))

    def delete(self, keys: DataFrame) -> VectorIndex:
        return VectorIndex(delete(self.rows, keys))

    def _of(self, model_id: int) -> DataFrame:
        return self.rows.where(F.col("model_id") == model_id).select("image_id", "vector")

    def search(self, model_id: int, query: list[float], k: int = 20) -> DataFrame:
        one = self.rows.sparkSession.createDataFrame([([float(x) for x in query],)], "query array<float>")
        return search(self._of(model_id), one, k, strict=True)

    def search_by_image_id(self, model_id: int, image_id: int, k: int = 20) -> DataFrame:
        """Raises KeyError if the image has no vector under the model."""
        mine = self._of(model_id)
        if mine.where(F.col("image_id") == image_id).limit(1).count() == 0:
            raise KeyError(image_id)
        return search_by_id(mine, self.rows.sparkSession.createDataFrame([(image_id,)], "image_id bigint"), k)
