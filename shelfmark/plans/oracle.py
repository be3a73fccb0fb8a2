"""Pieces of the DuckDB statements that the catalogue's queries are checked against."""

from __future__ import annotations

from ..functions.tags import SPACE

NOW = "TIMESTAMPTZ '2024-07-01 00:00:00+00'"


def trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def tag_list(column: str) -> str:
    """The strings of a JSON list; [] for all else."""
    ok = f"json_valid({column}) AND json_type(CASE WHEN json_valid({column}) THEN {column} ELSE '[]' END) = 'ARRAY'"
    return f"(CASE WHEN {ok} THEN list_filter(from_json({column}, '[\"VARCHAR\"]'), lambda t: t IS NOT NULL) ELSE []::VARCHAR[] END)"


def normalized(tags: str) -> str:
    return f"list_distinct(list_filter(list_transform({tags}, lambda t: lower({trimmed('t')})), lambda t: t <> ''))"


def adult(tags: str) -> str:
    return f"list_contains(list_transform({tags}, lambda t: lower({trimmed('t')})), 'nsfw')"


BASE = f"""
img AS (SELECT *, {tag_list("tags_json")} AS tags FROM images),
vid AS (SELECT *, {tag_list("tags_json")} AS tags FROM videos),
adult_videos AS (SELECT DISTINCT video_id FROM video_frames f JOIN img i USING (image_id) WHERE {adult("i.tags")} UNION SELECT video_id FROM vid WHERE {adult("tags")}),
newest AS (SELECT image_id, vector, row_number() OVER (PARTITION BY image_id ORDER BY updated_at DESC) AS rn FROM image_embeddings WHERE model_id = 1),
emb AS (SELECT image_id, vector::DOUBLE[] AS vector FROM newest WHERE rn = 1 AND len(vector) = 64
        AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
units AS (
  SELECT i.image_id, f.video_id, f.frame_index, f.timestamp_ms, i.tags AS image_tags, i.original_name AS image_name, i.storage_path AS image_path, i.mime_type AS image_mime,
         i.width AS image_width, i.height AS image_height, coalesce(i.description, '') AS image_description,
         CASE WHEN f.video_id IS NULL THEN {adult("i.tags")} ELSE a.video_id IS NOT NULL END AS adult
  FROM img i LEFT JOIN video_frames f USING (image_id) LEFT JOIN adult_videos a ON a.video_id = f.video_id),
shown AS (
  SELECT u.*, CASE WHEN u.video_id IS NULL THEN 'image' ELSE 'video' END AS media_type,
         CASE WHEN u.video_id IS NULL THEN image_name ELSE v.original_name END AS original_name,
         CASE WHEN u.video_id IS NULL THEN image_mime ELSE v.mime_type END AS mime_type,
         CASE WHEN u.video_id IS NOT NULL AND v.width > 0 THEN v.width ELSE image_width END AS width,
         CASE WHEN u.video_id IS NOT NULL AND v.height > 0 THEN v.height ELSE image_height END AS height,
         CASE WHEN u.video_id IS NOT NULL AND trim(coalesce(v.description, '')) <> '' THEN v.description ELSE image_description END AS description,
         CASE WHEN u.video_id IS NOT NULL AND len(v.tags) > 0 THEN v.tags ELSE image_tags END AS tags,
         coalesce(v.transcript_text, '') AS transcript_text
  FROM units u LEFT JOIN vid v ON v.video_id = u.video_id)"""

SEED_IMAGE = "(SELECT min(image_id) FROM emb WHERE image_id % 11 = 3)"
SEED_VIDEO = "(SELECT min(video_id) FROM video_frames f JOIN emb USING (image_id) WHERE video_id % 7 = 2)"
QUERY_IMAGE = "(SELECT min(image_id) FROM emb WHERE image_id % 13 = 5)"

COLUMNS = "media_type, image_id, video_id, original_name, mime_type, width, height, description, array_to_string(tags, '|') AS tags"


def neighbours(query: str, k: int, leave_out: str = "NULL") -> str:
    """rank, image_id, distance of the k nearest rows to the vector of an image."""
    distance = f"1 - coalesce(list_cosine_similarity(vector, (SELECT vector FROM emb WHERE image_id = {query})), 0)"
    return f"SELECT row_number() OVER (ORDER BY distance, image_id) AS rank, * FROM (SELECT image_id, {distance} AS distance FROM emb WHERE image_id IS DISTINCT FROM {leave_out} ORDER BY 2, 1 LIMIT {k})"


def enriched(hits: str, include_adult: bool) -> str:
    """Results of a hit list, one per standalone hit or video."""
    keep = "true" if include_adult else "NOT adult"
    return f"""SELECT *, row_number() OVER (ORDER BY hit_rank, coalesce(video_id, 0)) AS rank FROM (
      SELECT s.*, h.rank AS hit_rank, h.distance, row_number() OVER (PARTITION BY s.video_id, CASE WHEN s.video_id IS NULL THEN h.rank END ORDER BY h.rank, s.frame_index) AS rn
      FROM shown s JOIN {hits} h USING (image_id) WHERE {keep}) WHERE rn = 1"""
