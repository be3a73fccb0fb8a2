"""The registered queries: every relational operator over its whole tables, and the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions import text as X
from ..functions import vectors as V
from ..operators import feedback, index, ingest, jobs, listing, search, stats, tag_search
from ..sources.library import Library
from . import oracle as O

QUERIES: dict = {}
SQL: dict[str, str] = {}


class TestLibrary(Library):
    """The test data has no table of transcript vectors: that of image 7 * video_id + 1 stands in for a video's."""

    def transcript_embeddings(self) -> DataFrame:
        videos = self.table("videos").select("video_id", (F.col("video_id") * 7 + 1).alias("image_id"))
        return videos.join(self.embeddings(), "image_id").select("video_id", "vector")


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(TestLibrary(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put


def _now():
    return F.lit("2024-07-01 00:00:00").cast("timestamp")


def _seed_image(lib: Library) -> DataFrame:
    return lib.embeddings().where("image_id % 11 = 3").agg(F.min("image_id").alias("image_id"))


def _query(lib: Library) -> DataFrame:
    q = lib.embeddings().where("image_id % 13 = 5").agg(F.min_by("vector", "image_id").alias("query"))
    return q.where("query is not null")


def _seed_video(lib: Library) -> DataFrame:
    return lib.frames.join(lib.embeddings().select("image_id"), "image_id", "left_semi").where("video_id % 7 = 2").agg(F.min("video_id").alias("video_id"))


def _shown(results: DataFrame, *more: str, distance: bool = True) -> DataFrame:
    columns = ["rank", "media_type", "image_id", "video_id", "original_name", "mime_type", "width", "height", "description"]
    return results.select(*columns, F.array_join("tags", "|").alias("tags"), *([F.round("distance", 6).alias("distance")] if distance else []), *more)


# --- scans and vectors -------------------------------------------------------------------------

for _table, _columns in {
    "images": "image_id, sha256, original_name, mime_type, width, height, description",
    "videos": "video_id, sha256, original_name, duration_ms, width, height, frame_count, transcript_text",
    "video_frames": "video_id, image_id, frame_index, timestamp_ms",
    "embedding_models": "model_id, name, version, dimensions, metric, normalized",
    "index_jobs": "job_id, kind, image_id, video_id, state, attempts, max_attempts, last_error",
}.items():
    register(f"scan_{_table}", f"SELECT {_columns} FROM {_table}")(lambda lib, t=_table, c=_columns: lib.table(t).select(*c.split(", ")))


@register("vector_scan", "SELECT image_id, model_id, dim, len(vector)::INT AS length FROM image_embeddings WHERE model_id = 1")
def _vector_scan(lib):
    return lib.table("image_embeddings").where("model_id = 1").select("image_id", "model_id", "dim", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("length"))


@register("embedding_lookup", f"WITH {O.BASE} SELECT image_id, len(vector)::INT AS dim, round(list_sum(vector), 4) AS total FROM emb WHERE image_id = {O.SEED_IMAGE}")
def _lookup(lib):
    rows = lib.embeddings().join(F.broadcast(_seed_image(lib)), "image_id", "left_semi")
    return rows.select("image_id", F.size("vector").alias("dim"), F.round(F.aggregate(V.doubles(F.col("vector")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_ALL_DISTANCES = f"WITH {O.BASE}, q AS (SELECT vector AS query FROM emb WHERE image_id = {O.QUERY_IMAGE})"


@register("cosine_all", f"{_ALL_DISTANCES} SELECT image_id, round(CASE WHEN list_sum(list_transform(vector, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity(vector, query) END, 6) AS cosine FROM emb, q")
def _cosine_all(lib):
    rows = lib.embeddings().crossJoin(F.broadcast(_query(lib)))
    return rows.select("image_id", F.round(V.cosine(F.col("vector"), F.col("query")), 6).alias("cosine"))


@register("nearest_to_query", f"WITH {O.BASE}, h AS ({O.neighbours(O.QUERY_IMAGE, 20)}) SELECT rank, image_id, round(distance, 6) AS distance FROM h")
def _nearest(lib):
    return index.search(lib.embeddings(), _query(lib), 20).select("rank", "image_id", F.round("distance", 6).alias("distance"))


@register("nearest_to_image", f"WITH {O.BASE}, h AS ({O.neighbours(O.SEED_IMAGE, 20, O.SEED_IMAGE)}) SELECT rank, image_id, round(distance, 6) AS distance FROM h")
def _nearest_image(lib):
    return index.search_by_id(lib.embeddings(), _seed_image(lib), 20).select("rank", "image_id", F.round("distance", 6).alias("distance"))


@register("nearest_quantized", f"WITH {O.BASE}, h AS ({O.neighbours(O.QUERY_IMAGE, 20)}) SELECT rank, image_id, round(distance, 6) AS distance FROM h")
def _nearest_quantized(lib):
    return index.search_quantized(lib.embeddings(), _query(lib), 20).select("rank", "image_id", F.round("distance", 6).alias("distance"))


@register("embedding_counts", "SELECT count(*) FILTER (model_id = 1) AS model_rows, count(*) AS all_rows, max(updated_at) FILTER (model_id = 1) AS newest FROM image_embeddings")
def _counts(lib):
    return index.counts(lib.table("image_embeddings"), 1)


@register("wrong_dimensions", "SELECT image_id, updated_at FROM image_embeddings WHERE model_id = 1 AND (vector IS NULL OR len(vector) <> 64)")
def _wrong(lib):
    return index.check_dimensions(lib.table("image_embeddings").where("model_id = 1"), 64).select("image_id", "updated_at")


_N2 = "list_sum(list_transform(vector, lambda x: x * x))"


@register("vector_norms", f"WITH {O.BASE} SELECT image_id, round(sqrt({_N2}), 5) AS norm, round(CASE WHEN {_N2} >= 1e-12 THEN vector[1] / sqrt({_N2}) END, 5) AS first, {_N2} >= 1e-12 AS has_direction FROM emb")
def _norms(lib):
    v = F.col("vector")
    return lib.embeddings().select("image_id", F.round(F.sqrt(V.squared_norm(v)), 5).alias("norm"), F.round(V.normalized(v)[0].cast("double"), 5).alias("first"), V.normalized(v).isNotNull().alias("has_direction"))


@register(
    "negative_query",
    f"""{_ALL_DISTANCES}, d AS (SELECT image_id, query, list_transform(list_zip(query, vector), lambda p: p[1] - p[2]) AS d FROM emb, q),
    n AS (SELECT *, list_sum(list_transform(d, lambda x: x * x)) AS n2 FROM d)
    SELECT image_id, round(CASE WHEN n2 < 1e-12 THEN query[1] ELSE d[1] / sqrt(n2) END, 4) AS first FROM n""",
)
def _negative(lib):
    rows = lib.embeddings().crossJoin(F.broadcast(_query(lib)))
    return rows.select("image_id", F.round(V.without(F.col("query"), F.col("vector"))[0].cast("double"), 4).alias("first"))


_UNIT = f"u AS (SELECT f.video_id, list_transform(e.vector, lambda x: x / sqrt(list_sum(list_transform(e.vector, lambda y: y * y)))) AS unit FROM video_frames f JOIN emb e USING (image_id) WHERE list_sum(list_transform(e.vector, lambda x: x * x)) >= 1e-12)"


@register("video_mean_vectors", f"WITH {O.BASE}, {_UNIT}, p AS (SELECT video_id, unnest(range(64)) AS pos, unnest(unit) AS x FROM u) SELECT video_id, pos::INT AS pos, round(avg(x), 5) AS mean FROM p GROUP BY ALL")
def _means(lib):
    rows = lib.frames.join(lib.embeddings(), "image_id")
    return V.mean_vector(rows, ["video_id"], "vector", 64).select("video_id", F.posexplode("mean").alias("pos", "m")).select("video_id", "pos", F.round("m", 5).alias("mean"))


@register("match_scores", f"{_ALL_DISTANCES} SELECT image_id, round(greatest(0, least(1, 1 - (1 - CASE WHEN {_N2} = 0 THEN 0 ELSE list_cosine_similarity(vector, query) END))), 6) AS score FROM emb, q")
def _scores(lib):
    rows = lib.embeddings().crossJoin(F.broadcast(_query(lib)))
    return rows.select("image_id", F.round(V.match_score(V.cosine_distance(F.col("vector"), F.col("query")), F.lit("")), 6).alias("score"))


# --- tags and policy ---------------------------------------------------------------------------


@register("decoded_tags", f"WITH {O.BASE} SELECT image_id, array_to_string(tags, '|') AS tags, len(tags)::INT AS n FROM img")
def _decoded(lib):
    return lib.images.select("image_id", F.array_join("tags", "|").alias("tags"), F.size("tags").alias("n"))


@register("normalized_tags", f"WITH {O.BASE} SELECT image_id, array_to_string(list_sort({O.normalized('tags')}), '|') AS tags FROM img")
def _normalized(lib):
    return lib.images.select("image_id", F.array_join(F.sort_array(T.normalized_tags(F.col("tags"))), "|").alias("tags"))


@register("adult_images", f"WITH {O.BASE} SELECT image_id FROM img WHERE {O.adult('tags')}")
def _adult_images(lib):
    return lib.images.where(T.is_adult(F.col("tags"))).select("image_id")


@register("adult_videos", f"WITH {O.BASE} SELECT video_id FROM adult_videos")
def _adult_videos(lib):
    return lib.adult_videos()


@register("adult_units", f"WITH {O.BASE} SELECT image_id, video_id, adult FROM units")
def _adult_units(lib):
    from ..operators.units import with_adult_flag

    units = lib.images.select("image_id", F.col("tags").alias("image_tags")).join(lib.frames.select("image_id", "video_id"), "image_id", "left")
    return with_adult_flag(lib, units).select("image_id", "video_id", "adult")


@register("standalone_images", "SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM video_frames)")
def _standalone(lib):
    return lib.standalone(lib.table("images")).select("image_id")


_KEPT = f"list_filter(list_transform(tags, lambda t: {O.trimmed('t')}), lambda t: t <> '')"


@register(
    "toggled_tags",
    f"""WITH {O.BASE}, k AS (SELECT image_id, {_KEPT} AS kept FROM img)
    SELECT image_id, array_to_string(CASE WHEN list_contains(list_transform(kept, lambda t: lower(t)), 'nsfw') THEN list_filter(kept, lambda t: lower(t) <> 'nsfw') ELSE list_append(kept, 'NSFW') END, '|') AS tags,
           NOT list_contains(list_transform(kept, lambda t: lower(t)), 'nsfw') AS present FROM k""",
)
def _toggled(lib):
    return lib.images.select("image_id", T.toggled(F.col("tags"), "NSFW").alias("x")).select("image_id", F.array_join("x.tags", "|").alias("tags"), F.col("x.present").alias("present"))


@register("flagged_tags", f"""WITH {O.BASE}, r AS (SELECT image_id, list_filter(tags, lambda t: lower({O.trimmed('t')}) <> 'nsfw') AS rest FROM img)
    SELECT image_id, array_to_string(CASE WHEN image_id % 2 = 0 THEN list_append(rest[1:9], 'nsfw') ELSE rest END, '|') AS tags FROM r""")
def _flagged(lib):
    return lib.images.select("image_id", F.array_join(T.with_adult_flag(F.col("tags"), F.col("image_id") % 2 == 0), "|").alias("tags"))


@register("tag_colours", f"WITH {O.BASE}, t AS (SELECT DISTINCT unnest({O.normalized('tags')}) AS tag FROM img) SELECT tag, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(tag, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS hash FROM t")
def _colours(lib):
    tags = lib.images.select(F.explode(T.normalized_tags(F.col("tags"))).alias("tag")).distinct()
    return tags.select("tag", T.colour_hash(F.col("tag")).alias("hash"))


_WANTED = ["outdoor", "teapot", "boat"]
_LIST = "['outdoor', 'teapot', 'boat']"


def _tag_search_sql(need: str, include_adult: bool, page: str = "") -> str:
    return f"""WITH {O.BASE}, m AS (SELECT s.*, len(list_intersect({O.normalized("image_tags")}, {_LIST}))::INT AS matched_count FROM shown s),
    x AS (SELECT *, coalesce(video_id, image_id) AS unit_id, row_number() OVER (PARTITION BY media_type, coalesce(video_id, image_id) ORDER BY matched_count DESC, image_id DESC, frame_index) AS rn
          FROM m WHERE matched_count >= {need} AND ({"true" if include_adult else "NOT adult"})),
    y AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY matched_count DESC, unit_id DESC, media_type) AS rank FROM x WHERE rn = 1)
    SELECT {"rank, total, " if page else ""}matched_count, {O.COLUMNS} FROM y {page}"""


def _tag_page(lib, match_all, include_adult, offset):
    r = tag_search.tag_search(lib, _WANTED[:1] if match_all else _WANTED, match_all, include_adult, 24, offset)
    return _shown(r, "matched_count", "total", distance=False)


@register("tag_search_any", _tag_search_sql("1", False, "WHERE rank <= 24"))
def _tag_any(lib):
    return _tag_page(lib, False, False, 0)


@register("tag_search_page", _tag_search_sql("1", True, "WHERE rank > 24 AND rank <= 48"))
def _tag_second(lib):
    return _tag_page(lib, False, True, 24)


@register("tag_search_all", _tag_search_sql("2", False).replace(_LIST, "['outdoor', 'rusty']"))
def _tag_all(lib):
    r = tag_search.tag_search(lib, ["outdoor", "rusty"], True, False, None)
    return _shown(r.withColumn("rank", F.lit(0)), "matched_count", distance=False).drop("rank")


_CLOUD = f"""WITH {O.BASE}, t AS (SELECT DISTINCT video_id IS NULL AS v, coalesce(video_id, image_id) AS unit_id, unnest({O.normalized("image_tags")}) AS tag FROM units WHERE keep_it),
    c AS (SELECT tag, count(*) AS count FROM t GROUP BY tag)"""


@register("tag_cloud", _CLOUD.replace("keep_it", "NOT adult") + """, p AS (SELECT * FROM c ORDER BY count DESC, tag LIMIT 60), r AS (SELECT *, (count - min(count) OVER ()) / greatest(1, max(count) OVER () - min(count) OVER ()) AS ratio FROM p)
    SELECT tag, count, (CASE WHEN max(count) OVER () <= min(count) OVER () THEN 2 WHEN ratio >= 0.75 THEN 4 WHEN ratio >= 0.45 THEN 3 WHEN ratio >= 0.2 THEN 2 ELSE 1 END)::INT AS size_class FROM r""")
def _cloud(lib):
    return tag_search.tag_cloud(lib)


@register("tag_cloud_prefix", _CLOUD.replace("keep_it", "true") + " SELECT tag, count FROM c WHERE tag LIKE 'te%' AND count >= 2")
def _cloud_prefix(lib):
    return tag_search.tag_cloud(lib, None, 2, "te", True)


@register("unit_tags", _CLOUD.replace("keep_it", "NOT adult") + " SELECT NOT v AS is_video, unit_id, tag FROM t")
def _unit_tags(lib):
    return tag_search.unit_tags(lib)


# --- search pipelines --------------------------------------------------------------------------


def _similar_sql(include_adult: bool) -> str:
    window = f"CASE WHEN {'false' if include_adult else 'true'} OR EXISTS (SELECT 1 FROM video_frames WHERE image_id = {O.SEED_IMAGE}) THEN 160 ELSE 20 END"
    return f"""WITH {O.BASE}, hits AS (SELECT * FROM ({O.neighbours(O.SEED_IMAGE, 160, O.SEED_IMAGE)}) WHERE rank <= {window}), res AS ({O.enriched("hits", include_adult)}),
    self AS (SELECT 1 AS rank, {O.SEED_IMAGE} AS image_id, 0.0::DOUBLE AS distance), anchor AS (SELECT * FROM ({O.enriched("self", include_adult)}) WHERE rank = 1),
    rest AS (SELECT * FROM res r WHERE r.image_id <> {O.SEED_IMAGE} AND NOT EXISTS (SELECT 1 FROM anchor a WHERE r.video_id = a.video_id OR (r.video_id IS NULL AND a.video_id IS NULL AND r.image_id = a.image_id))),
    both_ AS (SELECT true AS is_anchor, * FROM anchor UNION ALL SELECT false, * FROM rest),
    o AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY is_anchor DESC, rank) AS rank FROM both_)
    SELECT rank, {O.COLUMNS}, round(distance, 6) AS distance, is_anchor FROM o WHERE rank <= 20"""


@register("similar_images", _similar_sql(False))
def _similar(lib):
    return _shown(search.similar_images(lib, _seed_image(lib)), "is_anchor")


@register("similar_images_all", _similar_sql(True))
def _similar_all(lib):
    return _shown(search.similar_images(lib, _seed_image(lib), include_adult=True), "is_anchor")


@register("enriched_hits", f"WITH {O.BASE}, hits AS ({O.neighbours(O.QUERY_IMAGE, 200)}), res AS ({O.enriched('hits', True)}) SELECT rank, {O.COLUMNS}, round(distance, 6) AS distance, timestamp_ms FROM res")
def _enriched(lib):
    from ..operators.units import enrich

    return _shown(enrich(lib, index.search(lib.embeddings(), _query(lib), 200), True), "timestamp_ms")


_TRANSCRIPT = f"""tv AS (SELECT v.video_id, e.vector FROM videos v JOIN emb e ON e.image_id = v.video_id * 7 + 1),
  ts AS (SELECT video_id, 1 - coalesce(list_cosine_similarity(vector, (SELECT vector FROM emb WHERE image_id = {O.QUERY_IMAGE})), 0) AS distance FROM tv WHERE video_id NOT IN (SELECT video_id FROM adult_videos) ORDER BY 2, 1 LIMIT 160),
  pv AS (SELECT video_id, arg_min(image_id, frame_index) AS image_id FROM video_frames GROUP BY video_id),
  tr AS (SELECT row_number() OVER (ORDER BY ts.distance, ts.video_id) AS rank, 'video' AS media_type, coalesce(pv.image_id, 0) AS image_id, ts.video_id, v.original_name, v.mime_type, v.width, v.height, coalesce(v.description, '') AS description, v.tags, ts.distance
         FROM ts JOIN vid v USING (video_id) LEFT JOIN pv USING (video_id))"""


@register("transcript_search", f"WITH {O.BASE}, {_TRANSCRIPT} SELECT rank, {O.COLUMNS}, round(distance, 6) AS distance FROM tr")
def _transcripts(lib):
    return _shown(search.transcript_search(lib, _query(lib), 160))


def _text_sql(where: str) -> str:
    return f"""WITH {O.BASE}, {_TRANSCRIPT}, hits AS ({O.neighbours(O.QUERY_IMAGE, 160)}), res AS ({O.enriched("hits", False)}),
    al AS (SELECT media_type, image_id, video_id, original_name, mime_type, width, height, description, tags, distance, 0 AS src, rank FROM res
           UNION ALL SELECT media_type, image_id, video_id, original_name, mime_type, width, height, description, tags, distance, 1, rank FROM tr),
    un AS (SELECT *, row_number() OVER (PARTITION BY media_type, coalesce(video_id, image_id) ORDER BY distance, src, rank) AS rn FROM al),
    me AS (SELECT * EXCLUDE (rank, rn), row_number() OVER (ORDER BY distance, media_type, coalesce(video_id, image_id)) AS rank FROM un WHERE rn = 1),
    fi AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY rank) AS rank FROM me WHERE {where})
    SELECT rank, {O.COLUMNS}, round(distance, 6) AS distance FROM fi WHERE rank <= 20"""


@register("text_search", _text_sql("true"))
def _text(lib):
    return _shown(search.text_search(lib, _query(lib)))


@register("text_search_tags", _text_sql(f"len(list_intersect({O.normalized('tags')}, ['outdoor', 'indoor'])) > 0"))
def _text_tags(lib):
    return _shown(search.text_search(lib, _query(lib), required=["outdoor", "indoor"], match_all=False))


_SEEDF = f"sf AS (SELECT f.image_id, f.video_id FROM video_frames f JOIN emb USING (image_id) WHERE f.video_id = {O.SEED_VIDEO} ORDER BY f.frame_index, f.image_id LIMIT 1)"


@register("seed_frames", f"WITH {O.BASE} SELECT video_id, arg_min(image_id, (frame_index, image_id)) AS image_id FROM video_frames JOIN emb USING (image_id) GROUP BY video_id")
def _seed_frames(lib):
    having = lib.frames.join(lib.embeddings().select("image_id"), "image_id", "left_semi")
    return having.groupBy("video_id").agg(F.min_by("image_id", F.struct("frame_index", "image_id")).alias("image_id"))


def _similar_videos_sql(rank: str) -> str:
    return f"""WITH {O.BASE}, {_SEEDF}, hits AS ({O.neighbours("(SELECT image_id FROM sf)", 2568, "(SELECT image_id FROM sf)")}), res AS ({O.enriched("hits", False)}),
    ca AS (SELECT * FROM res WHERE media_type = 'video' AND video_id <> {O.SEED_VIDEO}),
    sc AS (SELECT *, greatest(-0.12, least(0.12, (len(list_intersect({O.normalized("tags")}, ['outdoor', 'boat'])) - len(list_intersect({O.normalized("tags")}, ['indoor']))) * 0.08)) - distance AS score FROM ca),
    o AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY {rank}) AS rank FROM sc)
    SELECT rank, {O.COLUMNS}, round(distance, 6) AS distance FROM o WHERE rank <= 40"""


@register("similar_videos", _similar_videos_sql("rank"))
def _similar_videos(lib):
    return _shown(search.similar_videos(lib, _seed_video(lib)))


@register("similar_videos_tags", _similar_videos_sql("score DESC, distance, rank"))
def _similar_videos_tags(lib):
    return _shown(search.similar_videos(lib, _seed_video(lib), prefer=["outdoor", "boat"], avoid=["indoor"]))


def _first_frames(rest: int, n: int) -> str:
    return f"SELECT image_id FROM video_frames JOIN emb USING (image_id) WHERE video_id = (SELECT min(video_id) FROM video_frames JOIN emb USING (image_id) WHERE video_id % 7 = {rest}) ORDER BY frame_index, image_id LIMIT {n}"


_SEEN_VIDEO = "(SELECT min(video_id) FROM video_frames JOIN emb USING (image_id) WHERE video_id % 7 = {})"
_FEEDBACK = f"""WITH {O.BASE}, {_SEEDF}, lk AS (SELECT DISTINCT image_id FROM ({_first_frames(3, 2)}) WHERE image_id NOT IN (SELECT image_id FROM sf)),
    sk AS (SELECT DISTINCT image_id FROM ({_first_frames(4, 1)}) WHERE image_id NOT IN (SELECT image_id FROM sf UNION ALL SELECT image_id FROM lk)),
    un AS (SELECT s, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS unit FROM (SELECT 1 AS s, image_id FROM lk UNION ALL SELECT 2, image_id FROM sk) JOIN emb USING (image_id)),
    pm AS (SELECT s, pos, avg(x) AS x FROM (SELECT s, unnest(range(64)) AS pos, unnest(unit) AS x FROM un) GROUP BY ALL),
    dl AS (SELECT pos, sum(CASE WHEN s = 1 THEN 0.35 ELSE -0.15 END * x) AS d FROM pm GROUP BY 1), ln AS (SELECT sqrt(sum(d * d)) AS length FROM dl),
    su AS (SELECT unnest(range(64)) AS pos, unnest(unit) AS x FROM (SELECT list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS unit FROM emb WHERE image_id = (SELECT image_id FROM sf))),
    mq AS (SELECT list(x + d * (SELECT CASE WHEN length > 0.35 THEN 0.35 / length ELSE 1 END FROM ln) ORDER BY pos) AS query FROM su JOIN dl USING (pos))"""


@register(
    "similar_videos_feedback",
    f"""{_FEEDBACK}, hits AS (SELECT row_number() OVER (ORDER BY distance, image_id) AS rank, * FROM (SELECT image_id, 1 - list_cosine_similarity(vector, (SELECT query FROM mq)) AS distance FROM emb WHERE image_id <> (SELECT image_id FROM sf) ORDER BY 2, 1 LIMIT 2584)),
    res AS ({O.enriched("hits", False)}), o AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY rank) AS rank FROM res WHERE media_type = 'video' AND video_id NOT IN ({O.SEED_VIDEO}, {_SEEN_VIDEO.format(3)}, {_SEEN_VIDEO.format(4)}))
    SELECT rank, {O.COLUMNS}, round(distance, 4) AS distance FROM o WHERE rank <= 40""",
)
def _similar_videos_feedback(lib):
    having = lib.frames.join(lib.embeddings().select("image_id"), "image_id", "left_semi")
    seen = [having.where(f"video_id % 7 = {rest}").agg(F.min("video_id")).collect()[0][0] for rest in (3, 4)]
    liked, skipped = ([r.image_id for r in having.where(F.col("video_id") == v).orderBy("frame_index", "image_id").limit(n).collect()] for v, n in zip(seen, (2, 1), strict=True))
    results = search.similar_videos(lib, _seed_video(lib), seen=seen, liked=liked, skipped=skipped)
    return _shown(results, distance=False).join(results.select("rank", F.round("distance", 4).alias("distance")), "rank")


@register(
    "video_feedback_queries",
    f"""WITH {O.BASE}, {_UNIT}, p AS (SELECT video_id, unnest(range(64)) AS pos, unnest(unit) AS x FROM u), a AS (SELECT video_id, pos, avg(x) AS x FROM p GROUP BY ALL), m AS (SELECT video_id, list(x ORDER BY pos) AS mean FROM a GROUP BY 1),
    s AS (SELECT video_id, arg_min(image_id, (frame_index, image_id)) AS image_id FROM video_frames JOIN emb USING (image_id) GROUP BY video_id),
    q AS (SELECT video_id, list_transform(e.vector, lambda x: x / sqrt(list_sum(list_transform(e.vector, lambda y: y * y)))) AS unit, list_transform(mean, lambda x: 0.35 * x) AS delta FROM s JOIN emb e USING (image_id) JOIN m USING (video_id)),
    d AS (SELECT *, sqrt(list_sum(list_transform(delta, lambda x: x * x))) AS length FROM q),
    n AS (SELECT video_id, list_transform(list_zip(unit, delta), lambda z: z[1] + z[2] * CASE WHEN length > 0.35 THEN 0.35 / length ELSE 1 END) AS moved FROM d)
    SELECT video_id, round(moved[1] / sqrt(list_sum(list_transform(moved, lambda x: x * x))), 4) AS first FROM n""",
)
def _feedback_queries(lib):
    means = V.mean_vector(lib.frames.join(lib.embeddings(), "image_id"), ["video_id"], "vector", 64)
    seeds = _seed_frames(lib).join(lib.embeddings(), "image_id").select("video_id", "vector")
    moved = V.feedback_query(F.col("vector"), F.col("mean"), F.lit(None).cast("array<double>"))
    return seeds.join(means, "video_id").select("video_id", F.round(moved[0].cast("double"), 4).alias("first"))


@register("feedback_vectors", f"WITH {O.BASE}, {_SEEDF} SELECT DISTINCT image_id FROM video_frames JOIN emb USING (image_id) WHERE (video_id % 3 = 1 OR video_id = {O.SEED_VIDEO}) AND image_id % 4 = 2 AND image_id NOT IN (SELECT image_id FROM sf)")
def _feedback_vectors(lib):
    seen = lib.videos.where("video_id % 3 = 1").select("video_id").unionByName(_seed_video(lib))
    ids = lib.images.where("image_id % 4 = 2").select("image_id")
    return search.usable_feedback(lib, ids, search.seed_frame(lib, _seed_video(lib)), seen).select("image_id")


@register(
    "buffer_rerank",
    f"""WITH {O.BASE}, hits AS ({O.neighbours(O.QUERY_IMAGE, 100)}), b AS (SELECT h.rank - 1 AS position, h.image_id, h.distance, {O.normalized("i.tags")} AS tags FROM hits h JOIN img i USING (image_id)),
    s AS (SELECT *, greatest(-0.08, least(0.08, 0.02 * (list_contains(tags, 'outdoor')::INT * 3.0 - list_contains(tags, 'indoor')::INT * 1.5))) - distance AS score FROM b),
    m AS (SELECT position, image_id, row_number() OVER (ORDER BY score DESC, position) + 4 AS place FROM s WHERE position >= 5)
    SELECT position, image_id, place FROM m UNION ALL SELECT position, image_id, position FROM s WHERE position < 5""",
)
def _buffer_rerank(lib):
    hits = index.search(lib.embeddings(), _query(lib), 100)
    items = lib.images.select("image_id", "tags").join(F.broadcast(hits), "image_id").select((F.col("rank") - 1).alias("position"), "image_id", "distance", "tags")
    scores = lib.spark.createDataFrame([("outdoor", 3.0), ("indoor", -1.5)], "tag string, score double")
    return search.buffer_rerank(items, scores, 3).select("position", "image_id", F.col("order").alias("place"))


# --- lists -------------------------------------------------------------------------------------

_IMAGE_LIST = f"""WITH {O.BASE}, l AS (SELECT i.image_id, i.original_name, coalesce(j.state, 'pending') AS index_state FROM img i LEFT JOIN index_jobs j ON j.image_id = i.image_id AND j.model_id = 1 AND j.kind = 'embed_image'
    WHERE i.image_id NOT IN (SELECT image_id FROM video_frames) AND NOT {O.adult("i.tags")})"""
_KEY = "(((({k} * 1103515245 + 42) & 2147483647) | ((({k} * 1103515245 + 42) & 2147483647) >> 16)) * 1103515245 + 12345) & 2147483647"


@register("image_list", f"{_IMAGE_LIST} SELECT * FROM l")
def _image_list(lib):
    return listing.image_list(lib).select("image_id", "original_name", "index_state")


@register("image_page_newest", f"{_IMAGE_LIST}, p AS (SELECT *, row_number() OVER (ORDER BY image_id DESC) AS rank, count(*) OVER () AS total FROM l) SELECT * FROM p WHERE rank > 50 AND rank <= 100")
def _image_newest(lib):
    return listing.page(listing.image_list(lib), "image_id", limit=50, offset=50).select("image_id", "original_name", "index_state", "rank", "total")


@register("image_page_shuffled", f"{_IMAGE_LIST}, p AS (SELECT *, row_number() OVER (ORDER BY {_KEY.format(k='image_id')}, image_id) AS rank, count(*) OVER () AS total FROM l) SELECT * FROM p WHERE rank <= 50")
def _image_shuffled(lib):
    return listing.page(listing.image_list(lib), "image_id", "random", 42).select("image_id", "original_name", "index_state", "rank", "total")


def _job_counts_sql(kind: str) -> str:
    return f"SELECT video_id, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'done') AS done, count(*) AS total FROM index_jobs WHERE video_id IS NOT NULL AND model_id = 1 AND kind = '{kind}' GROUP BY 1"


_VIDEO_LIST = f"""WITH {O.BASE}, f AS (SELECT v.video_id, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'done') AS done, count(*) AS total
      FROM video_frames v JOIN index_jobs j ON j.image_id = v.image_id AND j.model_id = 1 AND j.kind = 'embed_image' GROUP BY 1),
    t AS ({_job_counts_sql("transcribe_video")}), a AS ({_job_counts_sql("annotate_video")}), pf AS (SELECT video_id, arg_min(image_id, frame_index) AS image_id FROM video_frames GROUP BY 1),
    l AS (SELECT v.video_id, v.original_name, coalesce(pf.image_id, 0) AS preview_image_id,
      CASE WHEN coalesce(f.failed, 0) > 0 OR coalesce(t.failed, 0) > 0 OR coalesce(a.failed, 0) > 0 THEN 'failed' WHEN coalesce(f.leased, 0) > 0 OR coalesce(t.leased, 0) > 0 OR coalesce(a.leased, 0) > 0 THEN 'leased'
           WHEN coalesce(f.total, 0) > 0 AND f.done = f.total AND coalesce(t.done, 0) = coalesce(t.total, 0) AND coalesce(a.done, 0) = coalesce(a.total, 0) THEN 'done' ELSE 'pending' END AS index_state
      FROM videos v LEFT JOIN f USING (video_id) LEFT JOIN t USING (video_id) LEFT JOIN a USING (video_id) LEFT JOIN pf USING (video_id) WHERE v.video_id NOT IN (SELECT video_id FROM adult_videos))"""


@register("video_list", f"{_VIDEO_LIST} SELECT * FROM l")
def _video_list(lib):
    return listing.video_list(lib).select("video_id", "original_name", "preview_image_id", "index_state")


@register("video_page_shuffled", f"{_VIDEO_LIST}, p AS (SELECT *, row_number() OVER (ORDER BY {_KEY.format(k='video_id')}, video_id) AS rank, count(*) OVER () AS total FROM l) SELECT * FROM p WHERE rank <= 50")
def _video_shuffled(lib):
    return listing.page(listing.video_list(lib), "video_id", "random", 42).select("video_id", "original_name", "preview_image_id", "index_state", "rank", "total")


@register("video_orphans", "SELECT image_id FROM (SELECT image_id, count(*) AS n, count(*) FILTER (video_id % 5 = 1) AS g FROM video_frames GROUP BY 1) WHERE g > 0 AND n = g")
def _orphans(lib):
    return listing.orphan_frames(lib, lib.videos.where("video_id % 5 = 1"))


@register("images_after_delete", "SELECT image_id, original_name FROM images WHERE NOT (image_id % 5 = 1 AND image_id NOT IN (SELECT image_id FROM video_frames))")
def _after_delete(lib):
    return listing.delete_images(lib, lib.images.where("image_id % 5 = 1"))["images"].select("image_id", "original_name")


@register("images_after_video_delete", "WITH o AS (SELECT image_id FROM (SELECT image_id, count(*) AS n, count(*) FILTER (video_id % 5 = 1) AS g FROM video_frames GROUP BY 1) WHERE g > 0 AND n = g) SELECT image_id, original_name FROM images WHERE image_id NOT IN (SELECT image_id FROM o)")
def _after_video_delete(lib):
    return listing.delete_videos(lib, lib.videos.where("video_id % 5 = 1"))["images"].select("image_id", "original_name")


@register("images_after_reannotate", "SELECT image_id, CASE WHEN image_id % 3 = 0 THEN '' ELSE description END AS description, CASE WHEN image_id % 3 = 0 THEN '[]' ELSE tags_json END AS tags_json, image_id % 3 = 0 OR reannotate_requested AS reannotate_requested FROM images")
def _after_reannotate(lib):
    images = lib.table("images")
    return listing.reannotate(images, "image_id", images.where("image_id % 3 = 0")).select("image_id", "description", "tags_json", "reannotate_requested")


# --- statistics --------------------------------------------------------------------------------

_DUE = f"(run_after IS NULL OR run_after <= {O.NOW})"
_RUN = f"({_DUE} AND (state = 'pending' OR (state = 'leased' AND leased_until IS NOT NULL AND leased_until <= {O.NOW})))"
_AGE = f"CASE WHEN state = 'pending' AND {_DUE} THEN floor(epoch({O.NOW})) - floor(epoch(coalesce(run_after, created_at))) WHEN {_RUN} THEN floor(epoch({O.NOW})) - floor(epoch(greatest(run_after, leased_until))) ELSE 0 END"


@register("kind_stats", f"SELECT kind, count(*) AS tracked, count(*) FILTER ({_RUN}) AS runnable, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'leased') AS leased, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, max({_AGE})::BIGINT AS oldest_runnable_age_seconds FROM index_jobs WHERE model_id = 1 GROUP BY kind")
def _kind_stats(lib):
    return stats.kind_stats(lib, _now())


_MISSING = "(trim(coalesce(description, '')) = '' OR coalesce(tags_json, '') IN ('', '[]'))"
_LACK = f"(SELECT image_id FROM images WHERE {_MISSING} AND image_id NOT IN (SELECT image_id FROM video_frames))"


@register(
    "library_counts",
    f"""WITH c AS (SELECT (SELECT count(*) FROM images) AS images_total, (SELECT count(*) FROM images WHERE image_id NOT IN (SELECT image_id FROM video_frames)) AS standalone_images_total, (SELECT count(*) FROM videos) AS videos_total,
      (SELECT count(*) FROM index_jobs WHERE model_id = 1 AND kind = 'embed_image') AS tracked, (SELECT count(*) FROM index_jobs WHERE model_id = 1 AND kind = 'embed_image' AND state = 'done' AND image_id IN {_LACK}) AS annotations_missing)
    SELECT *, greatest(images_total - standalone_images_total, 0) AS video_frame_images_total, greatest(images_total - tracked, 0) AS missing, tracked + greatest(images_total - tracked, 0) AS total FROM c""",
)
def _library_counts(lib):
    return stats.library_counts(lib)


@register(
    "recent_failures",
    """SELECT row_number() OVER (ORDER BY j.updated_at DESC, j.job_id DESC) AS rank, j.job_id, j.kind, CASE WHEN j.video_id IS NOT NULL THEN 'video' ELSE 'image' END AS media_type, coalesce(j.image_id, 0) AS image_id, coalesce(j.video_id, 0) AS video_id,
      coalesce(i.original_name, v.original_name, '') AS original_name, j.attempts, coalesce(j.last_error, '') AS last_error, j.updated_at
    FROM index_jobs j LEFT JOIN images i ON i.image_id = j.image_id LEFT JOIN videos v ON v.video_id = j.video_id WHERE j.model_id = 1 AND j.state = 'failed' ORDER BY j.updated_at DESC, j.job_id DESC LIMIT 10""",
)
def _recent_failures(lib):
    return stats.recent_failures(lib)


@register("snapshot_diff", "SELECT image_id, 'changed' AS change FROM images WHERE image_id % 3 = 0 AND image_id % 7 <> 1 AND NOT reannotate_requested UNION ALL SELECT image_id, 'removed' FROM images WHERE image_id % 7 = 1")
def _snapshot_diff(lib):
    images = lib.table("images")
    after = images.where("image_id % 7 <> 1").withColumn("reannotate_requested", F.col("reannotate_requested") | (F.col("image_id") % 3 == 0))
    return stats.snapshot_diff(images, after, "image_id", ["original_name", "reannotate_requested"])


# --- the queue ---------------------------------------------------------------------------------

_PRIORITY = "CASE kind WHEN 'embed_image' THEN 0 WHEN 'transcribe_video' THEN 1 WHEN 'annotate_image' THEN 2 WHEN 'annotate_video' THEN 3 ELSE 4 END"


@register("runnable_jobs", f"SELECT job_id, kind FROM index_jobs WHERE {_RUN}")
def _runnable(lib):
    return lib.jobs.where(jobs.runnable(_now())).select("job_id", "kind")


@register("claimable_jobs", f"SELECT row_number() OVER (ORDER BY created_at, job_id) AS rank, job_id, kind FROM index_jobs WHERE model_id = 1 AND {_RUN} AND kind = (SELECT kind FROM index_jobs WHERE model_id = 1 AND {_RUN} ORDER BY {_PRIORITY}, created_at, job_id LIMIT 1) ORDER BY created_at, job_id LIMIT 8")
def _claimable(lib):
    return jobs.claimable(lib.jobs, 1, _now(), 8).select("rank", "job_id", "kind")


@register(
    "queue_after_claim",
    f"""WITH c AS (SELECT job_id FROM index_jobs WHERE model_id = 1 AND {_RUN} AND kind = 'embed_image' ORDER BY created_at, job_id LIMIT 8)
    SELECT job_id, CASE WHEN c.job_id IS NOT NULL THEN 'leased' ELSE state END AS state, CASE WHEN c.job_id IS NOT NULL THEN 'worker' ELSE lease_owner END AS lease_owner, CASE WHEN c.job_id IS NOT NULL THEN {O.NOW} + INTERVAL 30 SECOND ELSE leased_until END AS leased_until,
      (attempts + (c.job_id IS NOT NULL)::INT)::INT AS attempts FROM index_jobs j LEFT JOIN c USING (job_id)""",
)
def _after_claim(lib):
    return jobs.claim(lib.jobs, jobs.claimable(lib.jobs, 1, _now(), 8), "worker", _now()).select("job_id", "state", "lease_owner", "leased_until", "attempts")


@register(
    "queue_after_errors",
    f"""WITH j AS (SELECT *, state = 'leased' AS hit, attempts >= max_attempts AS spent, least(300, 5 * pow(2.0, greatest(attempts - 1, 0)))::INT AS wait FROM index_jobs)
    SELECT job_id, CASE WHEN NOT hit THEN state WHEN spent THEN 'failed' ELSE 'pending' END AS state, CASE WHEN NOT hit THEN run_after WHEN spent THEN NULL ELSE {O.NOW} + to_seconds(wait) END AS run_after, CASE WHEN hit THEN 'boom' ELSE last_error END AS last_error FROM j""",
)
def _after_errors(lib):
    errors = lib.jobs.where("state = 'leased'").select("job_id", F.lit("boom").alias("error"))
    return jobs.fail_or_retry(lib.jobs, errors, _now()).select("job_id", "state", "run_after", "last_error")


@register("queue_after_done", "SELECT job_id, CASE WHEN state = 'leased' THEN 'done' ELSE state END AS state, CASE WHEN state = 'leased' THEN NULL ELSE lease_owner END AS lease_owner, CASE WHEN state = 'leased' THEN NULL ELSE last_error END AS last_error FROM index_jobs")
def _after_done(lib):
    return jobs.complete(lib.jobs, lib.jobs.where("state = 'leased'"), _now()).select("job_id", "state", "lease_owner", "last_error")


@register("no_audio_errors", "SELECT job_id, coalesce(lower(last_error) SIMILAR TO '.*(no audio|does not contain any stream|matches no streams).*', false) AS silent FROM index_jobs")
def _no_audio(lib):
    return lib.jobs.select("job_id", F.coalesce(jobs.no_audio(F.col("last_error")), F.lit(False)).alias("silent"))


@register("image_tasks", f"SELECT j.job_id, j.kind, j.image_id, i.original_name, i.storage_path, {_MISSING} AS needs_annotation, f.at[1] AS video_id, f.at[2]::INT AS frame_index FROM index_jobs j JOIN images i USING (image_id) LEFT JOIN (SELECT image_id, min([video_id, frame_index]) AS at FROM video_frames GROUP BY 1) f USING (image_id)")
def _image_tasks(lib):
    return jobs.image_tasks(lib, lib.jobs.where("image_id is not null")).drop("reannotate_requested")


@register("video_inputs", f"WITH {O.BASE} SELECT video_id, count(*)::INT AS n, string_agg(image_id::VARCHAR, ',' ORDER BY frame_index) AS images, arg_min(storage_path, frame_index) AS representative FROM video_frames JOIN img USING (image_id) GROUP BY 1")
def _video_inputs(lib):
    return jobs.video_inputs(lib).select("video_id", F.size("frames").alias("n"), F.array_join(F.transform("frames", lambda f: f["image_id"].cast("string")), ",").alias("images"), "representative")


def _missing_sql(kind: str, key: str, wanted: str) -> str:
    other = "video_id" if key == "image_id" else "image_id"
    return f"SELECT '{kind}' AS kind, w.{key}, NULL::BIGINT AS {other}, 1::BIGINT AS model_id, 'pending' AS state FROM ({wanted}) w WHERE w.{key} NOT IN (SELECT {key} FROM index_jobs WHERE kind = '{kind}' AND model_id = 1 AND {key} IS NOT NULL)"


_WANT_TRANSCRIPT = f"WITH {O.BASE} SELECT v.video_id FROM videos v WHERE trim(coalesce(v.transcript_text, '')) = '' OR v.video_id * 7 + 1 NOT IN (SELECT image_id FROM emb)"
for _name, _kind, _key, _sql, _f in (
    ("missing_embed_jobs", "embed_image", "image_id", "SELECT image_id FROM images", jobs.missing_embed_jobs),
    ("missing_annotate_jobs", "annotate_image", "image_id", _LACK[1:-1], jobs.missing_annotate_jobs),
    ("missing_transcribe_jobs", "transcribe_video", "video_id", _WANT_TRANSCRIPT, jobs.missing_transcribe_jobs),
    ("missing_annotate_video_jobs", "annotate_video", "video_id", f"SELECT video_id FROM videos WHERE {_MISSING}", jobs.missing_annotate_video_jobs),
):
    register(_name, _missing_sql(_kind, _key, _sql))(_f)


@register("queue_after_requeue", f"SELECT job_id, CASE WHEN kind = 'annotate_image' AND state = 'done' AND image_id IN {_LACK} THEN 'pending' ELSE state END AS state FROM index_jobs")
def _after_requeue(lib):
    return jobs.requeue_unannotated(lib, _now()).select("job_id", "state")


_RETRIED = f"(model_id = 1 AND (state = 'failed' OR (kind = 'annotate_image' AND state = 'done' AND coalesce(image_id IN {_LACK}, false))))"


@register("queue_after_retry", f"SELECT job_id, CASE WHEN {_RETRIED} THEN 'pending' ELSE state END AS state, CASE WHEN {_RETRIED} THEN 0 ELSE attempts END AS attempts, CASE WHEN {_RETRIED} THEN NULL ELSE last_error END AS last_error FROM index_jobs")
def _after_retry(lib):
    return jobs.retry_failed(lib, _now())[0].select("job_id", "state", "attempts", "last_error")


@register(
    "retry_counts",
    f"""SELECT count(*) FILTER (model_id = 1 AND state = 'failed') AS retried, count(*) FILTER (model_id = 1 AND kind = 'annotate_image' AND state = 'done' AND image_id IN {_LACK})
      + (SELECT count(*) FROM ({_missing_sql("embed_image", "image_id", "SELECT image_id FROM images")})) + (SELECT count(*) FROM ({_missing_sql("annotate_image", "image_id", _LACK[1:-1])}))
      + (SELECT count(*) FROM ({_missing_sql("annotate_video", "video_id", f"SELECT video_id FROM videos WHERE {_MISSING}")})) + (SELECT count(*) FROM ({_missing_sql("transcribe_video", "video_id", _WANT_TRANSCRIPT)})) AS enqueued FROM index_jobs""",
)
def _retry_counts(lib):
    return jobs.retry_failed(lib, _now())[2]


@register("queue_after_reannotate", "SELECT job_id, CASE WHEN kind = 'annotate_image' AND model_id = 1 AND image_id % 3 = 0 AND state <> 'leased' THEN 'pending' ELSE state END AS state FROM index_jobs")
def _requests(lib):
    items = lib.images.where("image_id % 3 = 0")
    return jobs.request_reannotation(lib.jobs, "image_id", "annotate_image", 1, items, _now())[0].select("job_id", "state")


@register("purged_embeddings", "SELECT image_id, updated_at FROM image_embeddings WHERE model_id = 1")
def _purged(lib):
    return jobs.purge_models(lib.table("image_embeddings"), 1).select("image_id", "updated_at")


# --- feedback ----------------------------------------------------------------------------------

_FIRST = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY received_at, observed_at) AS rn FROM interactions) WHERE rn = 1)"
_CLASS = "CASE WHEN NOT coalesce(playback_started, false) THEN 'neutral' WHEN coalesce(completion_ratio, 0) >= 0.75 OR action = 'ended' THEN 'positive' WHEN action = 'next' AND watch_ms < 3000 AND dwell_ms < 3000 AND coalesce(completion_ratio, 0) < 0.2 THEN 'soft_negative' ELSE 'neutral' END"


@register("feedback_classes", f"WITH {_FIRST} SELECT session_id, seq, image_id, {_CLASS} AS class FROM d")
def _classes(lib):
    return feedback.deduplicated(lib.table("interactions")).select("session_id", "seq", "image_id", feedback.classify().alias("class"))


_SCORES = f"""WITH {_FIRST}, k AS (SELECT session_id, seq, tags, CASE {_CLASS} WHEN 'positive' THEN 1.0 WHEN 'soft_negative' THEN -0.5 END AS step FROM d),
    t AS (SELECT session_id, seq, step, unnest(list_distinct(list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda t: t <> ''))) AS tag FROM k WHERE step IS NOT NULL),
    s AS (SELECT session_id, tag, list_reduce(list_prepend(0.0::DOUBLE, list(step::DOUBLE ORDER BY seq)), lambda a, x: greatest(-3.0, least(5.0, a + x))) AS score FROM t GROUP BY 1, 2)"""


@register("session_tag_scores", f"{_SCORES} SELECT session_id, tag, score FROM s")
def _session_scores(lib):
    return feedback.tag_scores(lib.table("interactions"))


@register("session_decay", f"{_SCORES} SELECT session_id, tag, round(score * 0.729, 6) AS score FROM s WHERE abs(score * 0.729) >= 0.05")
def _session_decay(lib):
    return feedback.decayed(feedback.tag_scores(lib.table("interactions")), 3).withColumn("score", F.round("score", 6))


@register("session_preferences", f"{_SCORES}, p AS (SELECT *, CASE WHEN score > 0 THEN 'prefer' ELSE 'avoid' END AS side FROM s WHERE abs(score) >= 0.25), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, side ORDER BY abs(score) DESC, tag) AS rank FROM p) SELECT session_id, side, rank, tag, score FROM r WHERE rank <= 12")
def _session_preferences(lib):
    return feedback.preferences(feedback.tag_scores(lib.table("interactions")))


@register(
    "session_recent_ids",
    f"""WITH {_FIRST}, k AS (SELECT session_id, image_id, seq, {_CLASS} AS class FROM d), m AS (SELECT session_id, image_id, max(seq) AS seq, arg_max(class, seq) AS class FROM k WHERE class <> 'neutral' GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY session_id, class ORDER BY seq DESC, image_id DESC) AS back FROM m)
    SELECT session_id, class, row_number() OVER (PARTITION BY session_id, class ORDER BY back DESC) AS place, image_id FROM b WHERE back <= 8""",
)
def _session_ids(lib):
    return feedback.recent_ids(lib.table("interactions"))


# --- names and labels --------------------------------------------------------------------------


@register("titles", f"""WITH t AS (SELECT image_id, original_name, {O.trimmed("coalesce(description, '')")} AS t FROM images), s AS (SELECT *, trim(regexp_replace(coalesce(nullif(regexp_extract(t, '^(?s)(.*?[.!?])\\s', 1), ''), t), '\\s+', ' ', 'g')) AS l FROM t)
    SELECT image_id, CASE WHEN t = '' THEN original_name WHEN len(l) > 160 THEN rtrim(l[1:159]) || '…' ELSE l END AS title FROM s""")
def _titles(lib):
    return lib.images.select("image_id", X.title(F.col("description"), F.col("original_name")).alias("title"))


@register("content_tokens", "SELECT image_id, sha256(original_name) AS digest, sha256(original_name)[1:12] AS token FROM images")
def _tokens(lib):
    return lib.images.select("image_id", F.sha2("original_name", 256).alias("digest"), X.short_digest(F.col("original_name")).alias("token"))


@register("version_tokens", f"WITH t AS (SELECT image_id, regexp_replace(regexp_replace(regexp_replace({O.trimmed('original_name')}, '[^A-Za-z0-9._-]', '_', 'g'), '^[._-]+', ''), '[._-]+$', '') AS t FROM images) SELECT image_id, CASE WHEN t = '' THEN 'unknown' ELSE t END AS token FROM t")
def _version_tokens(lib):
    return lib.images.select("image_id", X.version_token(F.col("original_name")).alias("token"))


_NOISE = " OR ".join(f"regexp_matches(low, '{p}')" for p in X.NOISY)
_FIELDS = r"[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@register(
    "filename_hints",
    f"""WITH s AS (SELECT image_id, regexp_replace(regexp_replace({O.trimmed("original_name")}, '^.*[/\\\\]', ''), '[.][^.]*$', '') AS stem FROM images),
    f AS (SELECT image_id, {O.trimmed(f"regexp_replace(regexp_replace(stem, '[_.-]', ' ', 'g'), '{_FIELDS}', ' ', 'g')")} AS spaced FROM s),
    w AS (SELECT image_id, {O.trimmed("regexp_replace(spaced, '[\\x{0}-\\x{1F}]', '', 'g')[1:80]")} AS words FROM f), l AS (SELECT *, lower(words) AS low FROM w)
    SELECT image_id, CASE WHEN NOT ({_NOISE}) AND len(list_filter(string_split(low, ' '), lambda w: len(regexp_replace(w, '[^a-z]', '', 'g')) >= 3)) >= 2 THEN words END AS hint FROM l""",
)
def _hints(lib):
    return lib.images.select("image_id", X.filename_hint(F.col("original_name")).alias("hint"))


@register("duration_labels", "SELECT video_id, (greatest(duration_ms, 0) // 60000)::VARCHAR || ':' || lpad(((greatest(duration_ms, 0) // 1000) % 60)::VARCHAR, 2, '0') AS label FROM videos")
def _durations(lib):
    return lib.videos.select("video_id", X.duration_label(F.col("duration_ms")).alias("label"))


@register("cleaned_transcripts", "SELECT video_id, regexp_replace(transcript_text, '\\p{Cc}', ' ', 'g')[1:1200] AS text FROM videos")
def _cleaned(lib):
    return lib.videos.select("video_id", X.without_controls(F.col("transcript_text"), 1200).alias("text"))


# --- ingest ------------------------------------------------------------------------------------


@register("sample_times", "SELECT video_id, unnest(range(10))::INT AS place, greatest(0, least(greatest(duration_ms - 1, 0), round(duration_ms * (unnest(range(10)) + 0.5) / 10)::BIGINT)) AS timestamp_ms FROM videos")
def _times(lib):
    return ingest.sample_times(lib.videos.select("video_id", "duration_ms"), 10)


@register(
    "accepted_uploads",
    """WITH o AS (SELECT *, nullif(regexp_extract(lower(trim(sha256, E' \\n\\t\\r')), '^(?:sha256:)?([0-9a-f]{64})$', 1), '') AS digest FROM uploads WHERE status = 'ok'), g AS (SELECT *, min(upload_id) OVER (PARTITION BY digest) AS first FROM o WHERE digest IS NOT NULL)
    SELECT upload_id, digest, first AS stored_id, upload_id <> first AS duplicate FROM g""",
)
def _accepted(lib):
    return ingest.store_once(lib.table("uploads").where("status = 'ok'"))


_INGEST = """WITH o AS (SELECT *, nullif(regexp_extract(lower(trim(sha256, E' \\n\\t\\r')), '^(?:sha256:)?([0-9a-f]{64})$', 1), '') AS digest FROM uploads WHERE status = 'ok'),
    f AS (SELECT * FROM o WHERE digest IS NOT NULL AND digest NOT IN (SELECT sha256 FROM images) QUALIFY row_number() OVER (PARTITION BY digest ORDER BY upload_id) = 1),
    n AS (SELECT (SELECT max(image_id) FROM images) + row_number() OVER (ORDER BY upload_id) AS image_id, digest AS sha256, filename AS original_name, mime_type, width, height FROM f)"""


def _ingest(lib):
    """All accepted uploads taken in; the images lack the contents of videos, which thus are new rows."""
    files = lib.table("uploads").where("status = 'ok'").select("upload_id", ingest.clean_digest(F.col("sha256")).alias("digest"), F.col("filename").alias("original_name"), "mime_type", "width", "height").where("digest is not null")
    return ingest.ingest_images(lib.table("images"), lib.jobs, files, 1, _now())


@register("ingested_images", f"{_INGEST} SELECT * FROM n")
def _ingested(lib):
    return _ingest(lib)[0].select("image_id", "sha256", "original_name", "mime_type", "width", "height")


@register("ingest_jobs", f"{_INGEST}, k AS (SELECT image_id FROM images WHERE sha256 IN (SELECT digest FROM o) UNION ALL SELECT image_id FROM n) SELECT image_id FROM k WHERE image_id NOT IN (SELECT image_id FROM index_jobs WHERE kind = 'embed_image' AND model_id = 1 AND image_id IS NOT NULL)")
def _ingest_jobs(lib):
    return _ingest(lib)[1].select("image_id")


@register(
    "upload_batches",
    """WITH o AS (SELECT *, nullif(regexp_extract(lower(trim(sha256, E' \\n\\t\\r')), '^(?:sha256:)?([0-9a-f]{64})$', 1), '') AS digest FROM uploads), g AS (SELECT *, status = 'ok' AND digest IS NOT NULL AND upload_id <> min(CASE WHEN status = 'ok' THEN upload_id END) OVER (PARTITION BY digest) AS dup FROM o),
    c AS (SELECT batch_no, count(*) AS files, count(*) FILTER (status = 'ok' AND NOT dup) AS created, count(*) FILTER (dup) AS duplicates, count(*) FILTER (status <> 'ok') AS failed FROM g GROUP BY 1)
    SELECT *, (CASE WHEN failed = files THEN 400 WHEN failed > 0 THEN 207 WHEN duplicates = files THEN 200 ELSE 201 END)::INT AS http_status FROM c""",
)
def _batches(lib):
    return ingest.batch_outcomes(lib.table("uploads"))
