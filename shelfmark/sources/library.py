"""The tables of the library and the views on them that every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.tags import decoded, is_adult
from ..runtime import cached, read_table, table_state

TABLES = ("images", "videos", "video_frames", "embedding_models", "image_embeddings", "index_jobs", "interactions", "uploads")
#: Version of the table layout.
CATALOGUE_VERSION = 7


class Library:
    """Lazy DataFrames over one data directory; nothing is read before an action needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str, model_id: int = 1) -> None:
        self.spark, self.sf_dir, self.model_id = spark, sf_dir, model_id

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @property
    def images(self) -> DataFrame:
        return self.table("images").withColumn("tags", decoded(F.col("tags_json")))

    @property
    def videos(self) -> DataFrame:
        return self.table("videos").withColumn("tags", decoded(F.col("tags_json")))

    @property
    def frames(self) -> DataFrame:
        return self.table("video_frames")

    @property
    def jobs(self) -> DataFrame:
        return self.table("index_jobs")

    def embeddings(self, dim: int = 64) -> DataFrame:
        """``image_id, vector``: the newest row per image of the active model, if its vector can be compared.

        Vectors that are null, of another length, or hold nulls, NaN or infinities are left out.
        This is the index that searches scan: it is written once, and again when the files of the
        table change, so that a search moves no vector between tasks.
        """
        if not self.sf_dir:
            return self._newest(dim)
        path = f"{self.sf_dir}/image_embeddings.parquet"
        return cached(self.spark, f"vectors-{self.model_id}-{dim}", f"{path}-{table_state(self.spark, path)}".replace("/", "_"), lambda: self._newest(dim))

    def _newest(self, dim: int) -> DataFrame:
        rows = self.table("image_embeddings").where(F.col("model_id") == self.model_id).select("image_id", "updated_at", "vector")
        newest = Window.partitionBy("image_id").orderBy(F.desc("updated_at"))
        rows = rows.withColumn("rn", F.row_number().over(newest)).where("rn = 1")
        return rows.where((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select("image_id", "vector")

    def adult_videos(self, among: DataFrame | None = None) -> DataFrame:
        """``video_id`` of videos with the adult tag on themselves or on any of their frames.

        ``among`` (video_id, a bounded list) leaves out all other videos before anything is joined.
        """
        few = (lambda df: df) if among is None else (lambda df: df.join(F.broadcast(among), "video_id", "left_semi"))
        flagged = self._adult("images").select("image_id")
        by_frame = few(self.frames).join(flagged, "image_id", "left_semi").select("video_id")
        return by_frame.unionByName(few(self._adult("videos")).select("video_id")).distinct()

    def _adult(self, name: str) -> DataFrame:
        """Rows with the adult tag; only texts that can hold it are decoded."""
        raw = F.lower("tags_json")
        rows = self.table(name).where(raw.contains("nsfw") | raw.contains("\\u"))
        return rows.where(is_adult(decoded(F.col("tags_json"))))

    def standalone(self, images: DataFrame | None = None) -> DataFrame:
        """Images that are no frame of any video."""
        return (self.images if images is None else images).join(self.frames.select("image_id"), "image_id", "left_anti")

    def transcript_embeddings(self) -> DataFrame:
        """``video_id, vector``: the table ``transcript_embeddings`` of the active model; no rows where the library has none."""
        try:
            rows = self.table("transcript_embeddings")
        except (AnalysisException, KeyError):
            return self.spark.createDataFrame([], "video_id bigint, vector array<float>")
        return rows.where(F.col("model_id") == self.model_id).select("video_id", "vector")
