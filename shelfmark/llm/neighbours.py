"""Most similar vectors for every vector, by cross-polytope hashing with multiprobe tables.

A unit vector goes through three rounds of random signs and a fast Hadamard transform, a
pseudo-rotation, and hashes to its nearest signed axis.  Several such hashes, the last of them
among fewer axes, make the bucket of a table.  Every vector is stored in its home bucket of each
table; a query looks into its home bucket and the next likeliest ones, ranked by how much farther
the swapped axes are.  How many buckets, tables and probes there are follows from the number of
vectors: the cheapest plan that finds a pair at the wanted distance with the wanted probability.  Buckets compare 8-bit copies of the vectors; every candidate that can be among
the best within the proven error of its cosine is reranked with the exact distance 1 - cosine of
the stored vectors.  Where too many of a cell can be (many vectors that are nearly equal), the
cell's stored vectors are compared themselves.

Equal vectors are gathered first and hashed once, so a group of copies of any size is one point.
A bucket of more than ``block`` rows is split into a grid of cells: a stored row goes to the cells
of one row, a query to those of one column, so no cell is unbounded and no pair is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage

SEED = 20240117
#: Candidates that may be among the best, beyond k, for which a cell is not compared exactly.
MORE = 11
#: Up to so many hot buckets are broadcast; more are joined by shuffle, with equal rows.
SENT_BUCKETS = 100_000


def usable_vectors(embeddings: DataFrame, model_id: int, dim: int) -> DataFrame:
    """``id, key, vector``: the newest row of each image under a model, if its vector is usable.

    Of an image's rows only the one with the newest ``updated_at`` counts; rows of the same time
    are taken in the order of their bytes.  A vector that is null, not ``dim`` long, all zero or
    not finite takes no part.  ``vector`` holds unit vectors as little-endian float32, ``key`` a
    digest of the given numbers: equal keys are copies.
    """
    rows = embeddings.where(F.col("model_id") == model_id).select(F.col("image_id").alias("id"), "updated_at", "vector").where(F.col("id").isNotNull())
    order = Window.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("vector").desc_nulls_last())
    newest = rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("id", "vector")
    newest = newest.where((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    return newest.mapInArrow(_unit(dim), "id bigint, key binary, vector binary")


def _unit(dim: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0)
            wide = raw.astype(np.float64)
            norm = np.sqrt((wide * wide).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            unit = (wide[good] / norm[good, None]).astype("<f4")
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in raw[good]]
            ids = batch.column(0).to_numpy(zero_copy_only=False)[good]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in unit], pa.binary())], schema=schema)

    return run


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def pseudo_rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and Hadamard transform, which keep lengths up to one factor."""
    for s in signs:
        x = hadamard(x * s)
    return x


def hash_axes(bits: int, dim: int) -> tuple[int, ...]:
    """The axes of each hash of a table of 2 ** ``bits`` buckets: all, but fewer for the last; no hash for one bucket."""
    width = 1 << (dim - 1).bit_length()
    whole = (2 * width).bit_length() - 1
    rest = bits % whole
    return (width,) * (bits // whole) + ((1 << (rest - 1),) if rest else ())


@lru_cache(maxsize=256)
def _choices(sizes: tuple[int, ...], probes: int) -> np.ndarray:
    """Which alternative of each hash is taken, for all combinations that can be among the first ``probes`` + 1."""
    found: list[tuple[int, ...]] = [()]
    for size in sizes:
        found = [(*c, x) for c in found for x in range(size) if math.prod(y + 1 for y in (*c, x)) <= probes + 1 or (sum(c) == 0 and x > 0) or (sum(y > 0 for y in c) == 1 and x == 0)]
    return np.array(found, np.int64).reshape(len(found), len(sizes))


def bucket_codes(unit: np.ndarray, table: int, axes: tuple[int, ...], probes: int) -> np.ndarray:
    """The codes of the home bucket and up to ``probes`` next ones of each row, home first."""
    n, d = unit.shape
    width = 1 << (d - 1).bit_length()
    padded = np.zeros((n, width), np.float32)
    padded[:, :d] = unit
    own = np.zeros((n, 1), np.int64)
    if axes:
        near, cost = [], []
        for level, size in enumerate(axes):
            rng = np.random.default_rng([SEED, table, level])
            turned = pseudo_rotate(padded, rng.choice(np.array([-1, 1], np.float32), (3, width)))[:, :size]
            both = np.concatenate([turned, -turned], axis=1) / np.float32(width**1.5)
            kept = min(2 * size, probes + 1)
            best = np.argpartition(-both, kept - 1, axis=1)[:, :kept] if kept < 2 * size else np.tile(np.arange(2 * size), (n, 1))
            value = np.take_along_axis(both, best, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            near.append(np.take_along_axis(best, order, 1))
            value = np.take_along_axis(value, order, 1)
            cost.append((value[:, :1] - value) ** 2)
        choices = _choices(tuple(x.shape[1] for x in near), probes)
        total = sum(c[:, choices[:, level]] for level, c in enumerate(cost))
        take = np.argsort(total, axis=1, kind="stable")[:, : probes + 1]
        own, factor = np.zeros(take.shape, np.int64), 1
        for level, x in enumerate(near):
            own += np.take_along_axis(x, choices[:, level][take], 1) * factor
            factor *= 2 * axes[level]
    return own + (table << 48)


class Plan(NamedTuple):
    """The axes of each hash, and the numbers of tables and of probes beside the home bucket."""

    axes: tuple[int, ...]
    tables: int
    probes: int


@lru_cache(maxsize=256)
def _found_at(dim: int, axes: tuple[int, ...], distance: float, most: int) -> np.ndarray:
    """The share of pairs at ``distance`` that a table finds with 0, 1, ... ``most`` probes, on 600 random pairs."""
    rng = np.random.default_rng([SEED, dim])
    a, b = rng.standard_normal((2, 600, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = 1 - distance
    b = cosine * a + math.sqrt(max(1 - cosine * cosine, 0)) * b
    hits = bucket_codes(a.astype(np.float32), 999, axes, most) == bucket_codes(b.astype(np.float32), 999, axes, 0)
    return np.pad(np.cumsum(hits.mean(axis=0)), (0, max(most + 1 - hits.shape[1], 0)), "edge")[: most + 1]


#: Seconds of moving a hashed row and of one comparison, by which plans are told apart.
ROW_COST, PAIR_COST = 8e-6, 1e-8
#: Most tables, and most probes where every vector asks and where few do.
TABLES, PROBES, FEW_PROBES = 12, 16, 400


def choose_plan(stored: int, asking: int, dim: int, distance: float, recall: float) -> Plan:
    """The cheapest plan whose tables find a pair at ``distance`` with the probability ``recall``."""
    probes = PROBES if 4 * asking > stored else FEW_PROBES
    best = (ROW_COST * (stored + asking) + PAIR_COST * stored * asking, Plan((), 1, 0))
    for bits in range(1, max(stored, 2).bit_length()):
        axes = hash_axes(bits, dim)
        found = np.minimum(_found_at(dim, axes, distance, probes), 1 - 1e-12)
        # tables needed with each number of probes
        tables = np.maximum(np.ceil(math.log(1 - recall) / np.log1p(-np.maximum(found, 1e-12))), 1)
        asked = np.arange(1, probes + 2)
        cost = tables * (ROW_COST * (stored + asking * asked) + PAIR_COST * asking * asked * stored / 2**bits)
        cost[(tables > TABLES) | (asked > 2**bits)] = np.inf
        k = int(np.argmin(cost))
        if cost[k] < best[0]:
            best = (float(cost[k]), Plan(axes, int(tables[k]), k))
    return best[1]


def sketch(unit: np.ndarray) -> np.ndarray:
    """8-bit copies of unit vectors; the step is the vector's largest entry / 127, kept in front."""
    top = np.abs(unit).max(axis=1, keepdims=True).astype(np.float32)
    out = np.empty((len(unit), unit.shape[1] + 4), np.uint8)
    out[:, :4] = top.astype("<f4").view(np.uint8)
    out[:, 4:] = np.rint(unit * (127 / top)).astype(np.int8).view(np.uint8)
    return out


def unsketch(rows: np.ndarray) -> np.ndarray:
    top = np.ascontiguousarray(rows[:, :4]).view("<f4").astype(np.float32)
    return np.ascontiguousarray(rows[:, 4:]).view(np.int8).astype(np.float32) * (top / 127)


_HASHED = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("role", pa.int8()), ("code", pa.binary())])
_HASHED_DDL = "bucket bigint, id bigint, role tinyint, code binary"
#: Roles of a row in a bucket: stored only, query only, both.
STORED, QUERY, BOTH = 1, 2, 3


def _buckets(part: pa.RecordBatch, dim: int, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of rows (id, vector, asks); the bucket, row and role of each entry of the tables."""
    unit = np.frombuffer(b"".join(part.column(1).to_pylist()), "<f4").reshape(-1, dim)
    asks = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
    buckets, rows, roles = [], [], []
    for table in range(plan.tables):
        found = bucket_codes(unit, table, plan.axes, plan.probes)
        buckets += [found[:, 0], found[asks, 1:].ravel()]
        rows += [np.arange(len(unit)), np.repeat(np.flatnonzero(asks), found.shape[1] - 1)]
        roles += [np.where(asks, BOTH, STORED), np.full(len(rows[-1]), QUERY)]
    return unit, np.concatenate(buckets), np.concatenate(rows), np.concatenate(roles)


def _hash(dim: int, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                unit, buckets, rows, roles = _buckets(part, dim, plan)
                codes = pa.array([x.tobytes() for x in sketch(unit)], pa.binary())
                for k in range(0, len(rows), 50_000):
                    own = pa.array(rows[k : k + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(buckets[k : k + 50_000]), part.column(0).take(own), pa.array(roles[k : k + 50_000], pa.int8()), codes.take(own)], schema=_HASHED)

    return run


def _bucket_sizes(dim: int, plan: Plan):
    """How many rows of a task are stored in each bucket, and how many ask there."""
    schema = pa.schema([("bucket", pa.int64()), ("stored", pa.int64()), ("asking", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            buckets, at = np.unique(np.concatenate([b for b, _ in held]), return_inverse=True)
            roles = np.concatenate([r for _, r in held])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(buckets)] + [pa.array(np.bincount(at, weights=(roles & role) > 0, minlength=len(buckets)).astype(np.int64)) for role in (STORED, QUERY)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                _, buckets, _, roles = _buckets(batch.slice(at, 2048), dim, plan)
                held.append((buckets, roles))
                if sum(len(b) for b, _ in held) > 2_000_000:
                    yield emit()
        if held:
            yield emit()

    return run


_CANDIDATE = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("lower", pa.float32()), ("upper", pa.float32()), ("bucket", pa.int64()), ("part", pa.int32())])
_CANDIDATE_DDL = "id bigint, other bigint, lower float, upper float, bucket bigint, part int"


def sketch_errors(rows: np.ndarray) -> np.ndarray:
    """A bound on the length of the difference of each vector and its 8-bit copy: half a step in every entry, and rounding."""
    top = np.ascontiguousarray(rows[:, :4]).view("<f4").astype(np.float32)[:, 0]
    return top * np.float32(0.501 / 127 * np.sqrt(rows.shape[1] - 4))


def _compare(dim: int, k: int, least: float, exact: bool = False):
    """Within each bucket part: the stored rows that may be among the best ``k`` for each query row.

    ``lower`` and ``upper`` enclose the cosine.  From 8-bit copies, a query with more than k + MORE
    such rows has one row without ``other`` instead, which names the part.  With ``exact`` the
    vectors themselves are compared and each query has its ``k`` best rows.
    """

    def bucket(key: np.ndarray, ids: np.ndarray, roles: np.ndarray, unit: np.ndarray, error: np.ndarray, out: list) -> None:
        stored, asking = np.flatnonzero(roles & STORED), np.flatnonzero(roles & QUERY)
        if not len(stored) or not len(asking):
            return
        base, base_ids, base_error = unit[stored], ids[stored], error[stored]
        for at in range(0, len(asking), 512):
            q = asking[at : at + 512]
            near = unit[q] @ base.T
            # |ab - a'b'| <= |a - a'||b| + |a'||b - b'|, and the rounding of the product
            wide = 1e-6 if exact else error[q][:, None] + base_error[None, :] + error[q][:, None] * base_error[None, :] + np.float32(1e-5)
            near[ids[q][:, None] == base_ids[None, :]] = -9
            lower, upper = near - wide, near + wide
            hit = upper >= np.float32(least)
            hit[near == -9] = False
            if len(stored) > k:
                at_k = np.partition(near if exact else lower, len(stored) - k, axis=1)[:, len(stored) - k]
                hit &= (near >= at_k[:, None] - 1e-12) if exact else (upper >= at_k[:, None])
            many = np.flatnonzero(hit.sum(axis=1) > (k if exact else k + MORE))
            if exact:
                for i in many:  # equal cosines are taken in the order of ids
                    j = np.flatnonzero(hit[i])
                    hit[i, j[np.lexsort((base_ids[j], -np.round(near[i, j], 12)))[k:]]] = False
            else:
                hit[many] = False
                if len(many):
                    none = np.full(len(many), np.nan, np.float32)
                    out.append((ids[q][many], np.zeros(len(many), np.int64), none, none, np.full(len(many), key[0]), np.full(len(many), key[1], np.int32)))
            i, j = np.nonzero(hit)
            if len(i):
                out.append((ids[q][i], base_ids[j], lower[i, j].astype(np.float32), upper[i, j].astype(np.float32), np.zeros(len(i), np.int64), np.full(len(i), -1, np.int32)))

    def flush(out: list) -> pa.RecordBatch:
        columns = [np.concatenate([x[c] for x in out]) for c in range(6)]
        found = columns[5] < 0
        masks = [None, ~found, ~found, ~found, found, found]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type, mask=m) for c, t, m in zip(columns, _CANDIDATE, masks, strict=True)], schema=_CANDIDATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list = []

        def work(table: pa.Table) -> None:
            key = np.stack([table.column(k).to_numpy() for k in (0, 1)], axis=1)
            ids, roles = table.column(2).to_numpy(), table.column(3).to_numpy()
            raw = b"".join(table.column(4).to_pylist())
            if exact:
                unit = np.frombuffer(raw, "<f4").reshape(-1, dim).astype(np.float64)
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                error = np.zeros(len(unit), np.float32)
            else:
                copies = np.frombuffer(raw, np.uint8).reshape(-1, dim + 4)
                unit, error = unsketch(copies), sketch_errors(copies)
            edges = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(key)], strict=True):
                bucket(key[a], ids[a:b], roles[a:b], unit[a:b], error[a:b], out)

        for batch in batches:
            if not batch.num_rows:
                continue
            first, last = ((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()) for k in (0, batch.num_rows - 1))
            held.append(batch)
            if first == last and len(held) > 1 and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) == first:
                continue
            # everything before the last part of this batch is whole
            keys0, keys1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = int(np.argmax((keys0 == last[0]) & (keys1 == last[1])))
            whole = [*held[:-1], batch.slice(0, cut)]
            if any(x.num_rows for x in whole):
                work(pa.Table.from_batches(whole))
            held = [batch.slice(cut)]
            if out:
                yield flush(out)
                out.clear()
        if held:
            work(pa.Table.from_batches(held))
        if out:
            yield flush(out)

    return run


def _exact(dim: int):
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<f4").reshape(-1, dim).astype(np.float64) for k in (2, 3))
            cosine = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 - cosine)], schema=schema)

    return run


def nearest(
    vectors: DataFrame,
    dim: int,
    k: int = 5,
    max_distance: float | None = None,
    queries=None,
    distance: float | None = None,
    recall: float = 0.9,
    plan: Plan | None = None,
    block: int = 8192,
) -> DataFrame:
    """``id, other, distance``: the ``k`` nearest other vectors of every vector, or of ``queries``.

    ``vectors`` has the columns of ``usable_vectors``.  ``queries`` is a condition on ``id``;
    without it every vector asks.  Distances beyond ``max_distance`` are left out.  Hashing is
    planned to find a pair at ``distance`` (by default ``max_distance``, or else 0.5) from one of
    its sides with the probability ``recall``; nearer ones are found more often.  Equal distances are taken in the order of ``other``.  A vector without neighbours in its buckets
    has no row; empty tables give none.  Neighbours may be missed (hashing); copies never are.
    """
    vectors = stage(vectors, "unit-vectors")
    # Copies: the first k + 1 ids of each key; the smallest stands for all of them.
    light = vectors.select("id", "key")
    dup = stage(light.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"), "vector-copied")
    extra = stage(light.join(dup, "key").where(F.col("id") != F.col("leader")).select("id"), "vector-extra")
    alone = vectors.join(extra, "id", "left_anti")
    by_key = Window.partitionBy("key").orderBy("id")
    first = light.join(dup, "key", "left_semi").withColumn("rn", F.row_number().over(by_key)).where(F.col("rn") <= k + 1)
    lists = first.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    copies = stage(alone.select("id", "key").join(lists, "key", "left").select("key", F.coalesce("ids", F.array("id")).alias("ids")), "vector-copies")
    if queries is None:
        points = alone.select("id", "vector", F.lit(True).alias("asks"))
    else:  # a point asks for all its copies
        asking = vectors.where(queries).select("key").distinct().withColumn("asks", F.lit(True))
        points = stage(alone.join(asking, "key", "left").select("id", "vector", F.coalesce("asks", F.lit(False)).alias("asks")), "vector-asking")
    if plan is None:
        n = points.agg(F.count("*").alias("stored"), F.count_if("asks").alias("asking")).collect()[0]
        plan = choose_plan(n.stored, n.asking, dim, distance or max_distance or 0.5, recall)
    hashed = points.mapInArrow(_hash(dim, plan), _HASHED_DDL)
    sizes = points.mapInArrow(_bucket_sizes(dim, plan), "bucket bigint, stored bigint, asking bigint").groupBy("bucket").agg(F.sum("stored").alias("stored"), F.sum("asking").alias("asking"))
    return _finish(vectors, alone, copies, hashed, sizes, dim, k, max_distance, queries, block)


def _finish(vectors, alone, copies, hashed, sizes, dim, k, max_distance, queries, block) -> DataFrame:
    spark = vectors.sparkSession
    stores, asks = F.col("role").cast("int").bitwiseAND(STORED) > 0, F.col("role").cast("int").bitwiseAND(QUERY) > 0
    hot = sizes.where((F.col("stored") > block) | (F.col("asking") > block))
    cut = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    hot = stage(hot.select("bucket", cut("stored").alias("down"), cut("asking").alias("across")), "hot-buckets")
    split = hashed.join(F.broadcast(hot) if hot.count() <= SENT_BUCKETS else hot, "bucket", "left")
    # A hot bucket is a grid: a stored row goes to all cells of its row, a query to all cells of its column.
    down, across = F.col("down"), F.col("across")
    own_row, own_column = F.pmod(F.xxhash64("id"), down).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), across).cast("int")
    cell = lambda i, role: F.struct(i.cast("int").alias("part"), F.lit(role).alias("role"))
    none = F.array().cast("array<struct<part:int,role:int>>")
    grid = F.concat(
        F.when(stores, F.transform(F.sequence(F.lit(0), across - 1), lambda j: cell(own_row * across + j, STORED))).otherwise(none),
        F.when(asks, F.transform(F.sequence(F.lit(0), down - 1), lambda i: cell(i * across + own_column, QUERY))).otherwise(none),
    )
    spread = F.when(down.isNull(), F.array(F.struct(F.lit(0).alias("part"), F.col("role").cast("int").alias("role")))).otherwise(grid)
    rows = split.select("bucket", F.explode(spread).alias("x"), "id", "code").select("bucket", F.col("x.part").alias("part"), "id", F.col("x.role").cast("tinyint").alias("role"), "code")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_cell = lambda x: x.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part")
    least = -2.0 if max_distance is None else 1 - max_distance
    raw = stage(by_cell(rows).mapInArrow(_compare(dim, k, least), _CANDIDATE_DDL), "vector-hits")
    found = raw.where("other is not null").select("id", "other", "lower", "upper")
    open_ = raw.where("other is null").select("bucket", "part", "id")
    if open_.limit(1).collect():  # nearly equal vectors: these cells are compared with the stored vectors
        cells = rows.select("bucket", "part", "id", F.col("role").cast("int").alias("role")).join(open_.select("bucket", "part").distinct(), ["bucket", "part"], "left_semi")
        cells = cells.join(open_.withColumn("again", F.lit(QUERY)), ["bucket", "part", "id"], "left")
        role = F.col("role").bitwiseAND(F.lit(STORED).bitwiseOR(F.coalesce("again", F.lit(0)))).cast("tinyint")
        cells = cells.withColumn("role", role).where("role > 0").join(alone.select("id", "vector"), "id").select("bucket", "part", "id", "role", "vector")
        found = found.unionByName(by_cell(cells).mapInArrow(_compare(dim, k, least, True), _CANDIDATE_DDL).select("id", "other", "lower", "upper"))
    # what may be among the k best over all: its cosine can reach the k-th best lower bound
    best = Window.partitionBy("id").orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.groupBy("id", "other").agg(F.max("lower").alias("lower"), F.min("upper").alias("upper"))
    found = found.withColumn("least", F.nth_value("lower", k).over(best)).where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    if queries is None:  # a pair found from one side serves both
        found = found.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
    else:
        found = found.select("id", "other")
    found = stage(found, "vector-candidates")
    needed = found.select("id").union(found.select(F.col("other").alias("id"))).distinct()
    exact_rows = alone.select("id", "vector").join(needed, "id", "left_semi")
    a = exact_rows.select("id", F.col("vector").alias("va"))
    b = exact_rows.select(F.col("id").alias("other"), F.col("vector").alias("vb"))
    measured = found.join(a, "id").join(b, "other").select("id", "other", "va", "vb").mapInArrow(_exact(dim), "id bigint, other bigint, distance double")
    if max_distance is not None:
        measured = measured.where(F.col("distance") <= max_distance)
    if queries is None:
        measured = measured.unionByName(measured.select(F.col("other").alias("id"), F.col("id").alias("other"), "distance"))
    # Between points: the k nearest points of each.  A point stands for up to k + 1 of its copies.
    near = Window.partitionBy("id").orderBy("distance", "other")
    points_near = measured.withColumn("rn", F.row_number().over(near)).where(F.col("rn") <= k).drop("rn")
    leader = copies.select("key", "ids", F.col("ids")[0].alias("leader"))
    expanded = points_near.withColumnRenamed("id", "leader").join(leader.select(F.col("leader").alias("other"), "ids"), "other").select("leader", F.explode("ids").alias("other"), "distance")
    own_copies = leader.where(F.size("ids") > 1).select("leader", F.explode("ids").alias("other"), F.lit(0.0).alias("distance"))
    around = expanded.unionByName(own_copies)
    order = Window.partitionBy("leader").orderBy("distance", "other")
    around = around.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1).groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("list"))
    members = vectors if queries is None else vectors.where(queries)
    asked = members.select("id", "key").join(leader.select("key", "leader"), "key").join(around, "leader")
    picked = F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k)
    return asked.select("id", F.explode(picked).alias("x")).select("id", F.col("x.other").alias("other"), F.col("x.distance").alias("distance"))


def near_pairs(neighbours: DataFrame) -> DataFrame:
    """``image_id_a, image_id_b`` (a < b) of all pairs in which one is a neighbour of the other."""
    return neighbours.select(F.least("id", "other").alias("image_id_a"), F.greatest("id", "other").alias("image_id_b")).distinct()
