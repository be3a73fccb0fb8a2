"""The queries of this package over the library's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .term_counts import tag_counts

    return tag_counts(read_table(spark, sf_dir, "images")).where("mark <> 'useful'").select("tag")


def p1_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .term_counts import tag_counts

    return tag_counts(read_table(spark, sf_dir, "images"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "images").select("tags_json").unionByName(read_table(spark, sf_dir, "videos").select("tags_json"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cooccurrence import cooccurring

    records = _tagged(spark, sf_dir)
    pairs = cooccurring(records, "tags_json", max(5, -(-records.count() // 2000)))
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    strong = whole("n_ab") * whole("n_records") >= whole("n_a") * whole("n_b") * 4
    return pairs.where(strong).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cooccurrence import cooccurring

    pairs = cooccurring(_tagged(spark, sf_dir), "tags_json", 5)
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import near_pairs, nearest, usable_vectors

    return near_pairs(nearest(usable_vectors(read_table(spark, sf_dir, "image_embeddings"), 1, 64), 64, 5, 0.1, recall=0.95))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest, usable_vectors

    found = nearest(usable_vectors(read_table(spark, sf_dir, "image_embeddings"), 1, 64), 64, 5, queries=F.col("id") % 100 == 0, distance=0.5, recall=0.9)
    return found.select(F.col("id").alias("image_id"), F.col("other").alias("neighbour_id"), "distance")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_corpus

    return encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda table, kind, key, text: read_table(spark, sf_dir, table).select(F.lit(kind).alias("rec_kind"), F.col(key).alias("rec_id"), F.col(text).alias("text"))
    return part("images", "image", "image_id", "description").unionByName(part("videos", "video", "video_id", "transcript_text")).unionByName(part("documents", "document", "doc_id", "text"))


def _toxicity(spark: SparkSession, sf_dir: str):
    from .toxicity import fitted

    return fitted(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "review_labels"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_scores(spark, sf_dir).where("score >= 0.5").select("rec_kind", "rec_id")


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_texts

    return score_texts(_texts(spark, sf_dir), _toxicity(spark, sf_dir))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import source_name

    documents = read_table(spark, sf_dir, "documents")
    flagged = p2_scores(spark, sf_dir).where("rec_kind = 'document'").select("rec_id", (F.col("score") >= 0.5).cast("int").alias("case"))
    sources = documents.select(F.col("doc_id").alias("rec_id"), source_name(F.col("source")).alias("source"))
    return sources.join(flagged, "rec_id").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("case").alias("n_cases"), F.avg("case").alias("rate"))


def _spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spam import score_pages

    return score_pages(read_table(spark, sf_dir, "documents"), "doc_id", "text", "collection")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spam(spark, sf_dir).where("score > 0.5").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spam(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .history import repeated_uploads

    return repeated_uploads(read_table(spark, sf_dir, "uploads"))


def _mixture(spark: SparkSession, sf_dir: str):
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).texts


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report


QUERIES = {f.__name__: f for f in (p1_found, p1_tag_counts, p2_found, p2_scores, p2_rates, p3_found, p3_pairs, p4_found, p5_found, p5_neighbours, p6_ids, p7_mix, p7_shares, p8_found, p8_scores)}

# The white space of Unicode, as str.strip() takes it (fixed values).
_SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _tags_sql(table: str, key: str) -> str:
    """SELECT of the normalised tags of a table, one row each."""
    return rf"""
      SELECT '{table}' AS kind, {key} AS id, tag FROM (
        SELECT {key}, regexp_replace(regexp_replace(lower(nfc_normalize(json_extract_string(e, '$'))), '^{_SPACE}', ''), '{_SPACE}$', '') AS tag
        FROM (SELECT {key}, unnest(json_extract(tags_json, '$[*]')) AS e FROM {table}
              WHERE json_valid(tags_json) AND json_type(CASE WHEN json_valid(tags_json) THEN tags_json END) = 'ARRAY')
        WHERE json_type(e) = 'VARCHAR') WHERE tag <> ''"""


_COUNTS = f"""
  WITH t AS ({_tags_sql("images", "image_id")}),
  c AS (SELECT tag, count(*)::BIGINT AS n_occurrences, count(DISTINCT id)::BIGINT AS n_images FROM t GROUP BY tag),
  m AS (SELECT *, CASE WHEN n_images * 10 > (SELECT count(*) FROM images) THEN 'common' WHEN n_images <= 2 THEN 'rare' ELSE 'useful' END AS mark FROM c)"""

_PAIRS = f"""
  WITH t AS (SELECT DISTINCT * FROM ({_tags_sql("images", "image_id")} UNION ALL {_tags_sql("videos", "video_id")})),
  r AS (SELECT (SELECT count(*) FROM images) + (SELECT count(*) FROM videos) AS n),
  c AS (SELECT tag, count(*)::BIGINT AS n FROM t GROUP BY tag),
  p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*)::BIGINT AS n_ab FROM t a JOIN t b ON a.kind = b.kind AND a.id = b.id AND a.tag < b.tag GROUP BY ALL),
  x AS (SELECT p.*, ca.n AS n_a, cb.n AS n_b, r.n AS n FROM p JOIN c ca ON ca.tag = tag_a JOIN c cb ON cb.tag = tag_b, r WHERE n_ab >= 5)"""

SQL = {
    "p1_found": f"{_COUNTS} SELECT tag FROM m WHERE mark <> 'useful'",
    "p1_tag_counts": f"{_COUNTS} SELECT tag, n_occurrences, n_images, mark FROM m",
    "p3_found": f"{_PAIRS} SELECT tag_a, tag_b FROM x WHERE 2000 * n_ab >= n AND n_ab::HUGEINT * n >= 4::HUGEINT * n_a * n_b",
    "p3_pairs": f"{_PAIRS} SELECT tag_a, tag_b, n_a, n_b, n_ab, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b::DOUBLE), 6) AS lift FROM x",
    "p5_found": """
      WITH n AS (SELECT image_id, vector, row_number() OVER (PARTITION BY image_id ORDER BY updated_at DESC NULLS LAST, vector DESC NULLS LAST) AS rn FROM image_embeddings WHERE model_id = 1),
      u AS (SELECT image_id, vector::DOUBLE[] AS v FROM n WHERE rn = 1 AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
      d AS (SELECT a.image_id AS a, b.image_id AS b, 1 - list_cosine_similarity(a.v, b.v) AS d FROM u a JOIN u b ON a.image_id <> b.image_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rn FROM d)
      SELECT DISTINCT least(a, b) AS image_id_a, greatest(a, b) AS image_id_b FROM r WHERE rn <= 5 AND d <= 0.1""",
}
