"""Items that appear together: pair counts and lift, by heavy-light decomposition.

Items are split by their record count.  The ``heavy_items`` most frequent ones get a dense bit
matrix per block of records, and a pair's count is the popcount of the AND of two bit rows.  Pairs
of light items are hash-counted record by record.  Mixed pairs probe the heavy rows with the light
item's posting list.  Each block emits its distinct pairs once, so hot pairs are summed before the
shuffle.  The three kinds of pairs are disjoint; their union, summed over the blocks, is exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .tags import tags_of

#: Records of one bit-matrix block.
BLOCK = 65_536
#: Distinct pairs in a block's hash table before it is emitted early.
HASHED = 1_000_000

_PAIR = pa.schema([("item_a", pa.string()), ("item_b", pa.string()), ("n", pa.int64())])
_PAIR_DDL = "item_a string, item_b string, n bigint"


def distinct_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: record, raw; records without items are left out."""
    schema = pa.schema([("record", pa.int64()), ("items", pa.list_(pa.string()))])
    for batch in batches:
        rows = [(k, s) for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (s := sorted(set(tags_of(raw))))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.string()))], schema=schema)


def _emit(pairs: dict[tuple[str, str], int], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    keys = list(pairs)
    for at in range(0, len(keys), size):
        part = keys[at : at + size]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.string()), pa.array([pairs[k] for k in part], pa.int64())], schema=_PAIR)


def _ordered(a: str, b: str) -> tuple[str, str]:
    return (a, b) if a < b else (b, a)


def _dense(bits: np.ndarray, names: list[str]) -> Iterator[tuple[tuple[str, str], int]]:
    """Pairs of heavy items: popcounts over the packed rows of the matrix."""
    packed = np.packbits(bits, axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
    present = np.flatnonzero(np.bitwise_count(packed).sum(axis=1))
    packed = packed[present]
    for k in range(len(present) - 1):
        n = np.bitwise_count(packed[k + 1 :] & packed[k]).sum(axis=1, dtype=np.int64)
        for j in np.flatnonzero(n):
            yield _ordered(names[present[k]], names[present[k + 1 + j]]), int(n[j])


def _mixed(bits: np.ndarray, names: list[str], postings: dict[str, list[int]]) -> Iterator[tuple[tuple[str, str], int]]:
    """Pairs of a light and a heavy item: the light item's postings probe the heavy rows."""
    columns = np.ascontiguousarray(bits.T)
    light = list(postings)
    at = 0
    while at < len(light):
        end, size = at, 0
        while end < len(light) and (end == at or size + len(postings[light[end]]) <= 16_384):
            size += len(postings[light[end]])
            end += 1
        lists = [postings[x] for x in light[at:end]]
        starts = np.cumsum([0, *map(len, lists[:-1])])
        n = np.zeros((len(lists), bits.shape[0]), np.int64)
        rows = np.concatenate([np.asarray(x) for x in lists])
        # one light item may itself have many postings; it is probed in pieces
        if len(lists) == 1:
            for k in range(0, len(rows), 16_384):
                n[0] += columns[rows[k : k + 16_384]].sum(axis=0, dtype=np.int64)
        else:
            n = np.add.reduceat(columns[rows].astype(np.int32), starts, axis=0)
        for i, j in zip(*np.nonzero(n), strict=True):
            yield _ordered(light[at + i], names[j]), int(n[i, j])
        at = end


def _count_pairs(heavy: list[str]):
    index = {x: k for k, x in enumerate(heavy)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((len(heavy), BLOCK), np.uint8)
        postings: dict[str, list[int]] = defaultdict(list)
        pairs: Counter[tuple[str, str]] = Counter()
        rows = 0

        def close() -> None:
            nonlocal rows
            if heavy and rows:
                for key, n in _dense(bits[:, :rows], heavy):
                    pairs[key] += n
                for key, n in _mixed(bits[:, :rows], heavy, postings):
                    pairs[key] += n
            bits[:] = 0
            postings.clear()
            rows = 0

        for batch in batches:
            for items in batch.column(0).to_pylist():
                light, dense = [], False
                for x in sorted(items):
                    k = index.get(x)
                    if k is not None:
                        bits[k, rows] = 1
                        dense = True
                    else:
                        light.append(x)
                if dense:
                    for x in light:
                        postings[x].append(rows)
                for a in range(0, len(light), 1000):  # a very long record is counted piece by piece
                    pairs.update(combinations(light[a : a + 1000], 2))
                    for x in light[a : a + 1000]:
                        if a + 1000 < len(light):
                            pairs.update((x, y) for y in light[a + 1000 :])
                        if len(pairs) > HASHED:
                            yield from _emit(pairs)
                            pairs.clear()
                rows += 1
                if rows == BLOCK:
                    close()
                if len(pairs) > HASHED:
                    yield from _emit(pairs)
                    pairs.clear()
        close()
        yield from _emit(pairs)

    return run


def cooccurring(records: DataFrame, column: str, min_pairs: int = 1, heavy_items: int = 256) -> DataFrame:
    """``item_a, item_b, n_a, n_b, n_ab, n_records, lift`` of items that share a record.

    ``column`` holds JSON tag lists; an item counts once per record, ``item_a`` precedes
    ``item_b`` by code points, and ``n_records`` counts all rows, those without items included.
    ``lift`` is n_ab * n_records / (n_a * n_b).  Only pairs of at least ``min_pairs`` records are
    returned; an item below that count cannot be in such a pair, so leaving it out early is exact.
    Null, empty and malformed lists hold no items.
    """
    n_records = records.count()
    raw = records.select(F.monotonically_increasing_id().alias("record"), F.col(column).alias("raw"))
    items = stage(raw.mapInArrow(distinct_items, "record bigint, items array<string>"), "item-sets")  # numbers are fixed from here
    single = items.select("record", F.explode("items").alias("item"))
    counts = single.groupBy("item").count().where(F.col("count") >= min_pairs)
    counts = stage(counts.withColumnRenamed("count", "n"), "item-counts")
    heavy = [r.item for r in counts.orderBy(F.desc("n"), "item").limit(heavy_items).collect()]
    sets = items.select("items")
    if min_pairs > 1:
        # Items of too few records are left out by a join; the commonest ones, which would be its hot keys, need none.
        common = F.col("item").isin(heavy) if heavy else F.lit(False)
        kept = single.where(common).unionByName(single.where(~common).join(counts.select("item"), "item", "left_semi"))
        sets = kept.groupBy("record").agg(F.collect_list("item").alias("items")).where(F.size("items") > 1).select("items")
    pairs = sets.mapInArrow(_count_pairs(heavy), _PAIR_DDL)
    pairs = pairs.groupBy("item_a", "item_b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_pairs)
    a = counts.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = counts.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    lift = F.col("n_ab").cast("double") * n_records / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.join(a, "item_a").join(b, "item_b").select("item_a", "item_b", "n_a", "n_b", "n_ab", F.lit(n_records).cast("bigint").alias("n_records"), lift.alias("lift"))
