"""Frequency of every distinct tag or term, by burst-trie counting.

Each worker counts its rows in a burst trie (a trie whose leaves are small hash containers that
burst into a node when they grow), so that terms of one prefix share their path.  A worker whose
trie grows past ``spill_terms`` emits it and starts anew.  A trie is emitted in the order of its
terms, as compact subtrees: each term by what it shares with the one before, its rest and its
counters.  Subtrees are routed by adaptive prefixes: a prefix that holds more than its share of the
partial counts is extended to the next branch of its terms, until it is within its share or a
whole term.  Subtrees of one route meet in one task, which merges them in the order of their
nodes.  A frequent term is no hot key: it reaches the merge once per trie, not once per row.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .tags import tags_of

#: Entries of a container before it bursts.
BURST = 64
#: Terms of a subtree that is sent as one row.
SENT_TERMS = 5000


class _Node:
    __slots__ = ("end", "kids")

    def __init__(self) -> None:
        self.end: list[int] | None = None
        self.kids: dict[str, _Node | dict[str, list[int]]] = {}


class BurstTrie:
    """Counts terms; each has an occurrence and a record counter."""

    def __init__(self) -> None:
        self.root = _Node()
        self.size = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at, length = self.root, 0, len(term)
        while at < length:
            head = term[at]
            kid = node.kids.get(head)
            at += 1
            if type(kid) is _Node:
                node = kid
                continue
            if kid is None:
                kid = node.kids[head] = {}
            counter = kid.get(rest := term[at:])
            if counter is None:
                kid[rest] = [occurrences, records]
                self.size += 1
                if len(kid) > BURST:
                    node.kids[head] = self._burst(kid)
            else:
                counter[0] += occurrences
                counter[1] += records
            return
        if node.end is None:
            node.end = [0, 0]
            self.size += 1
        node.end[0] += occurrences
        node.end[1] += records

    @staticmethod
    def _burst(container: dict[str, list[int]]) -> _Node:
        node = _Node()
        for rest, counter in container.items():
            if rest:
                node.kids.setdefault(rest[0], {})[rest[1:]] = counter
            else:
                node.end = counter
        return node

    def items(self) -> Iterator[tuple[str, int, int]]:
        """All terms with their counters, in the order of code points."""
        stack: list[tuple[str, _Node | dict[str, list[int]]]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is _Node:
                if node.end is not None:
                    yield prefix, node.end[0], node.end[1]
                stack += [(prefix + head, node.kids[head]) for head in sorted(node.kids, reverse=True)]
            else:
                for rest in sorted(node):
                    yield prefix + rest, node[rest][0], node[rest][1]


_PARTIAL = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
_PARTIAL_DDL = "term string, occurrences bigint, records bigint"
Counts = Iterable[tuple[str, int, int]]


def shared_length(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def pack_subtree(rows: list[tuple[str, int, int]]) -> bytes:
    """Terms in order with their counters, as a compact trie: the length shared with the term before, and the rest."""
    shared = [0, *(shared_length(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))]
    rests = [t[k:] for (t, _, _), k in zip(rows, shared, strict=True)]
    numbers = np.array([(k, len(x), o, r) for k, x, (_, o, r) in zip(shared, rests, rows, strict=True)], "<i8")
    return len(rows).to_bytes(4, "little") + numbers.T.tobytes() + "".join(rests).encode("utf-8", "surrogatepass")


def unpack_subtree(blob: bytes) -> Iterator[tuple[str, int, int]]:
    n = int.from_bytes(blob[:4], "little")
    shared, sizes, occurrences, records = np.frombuffer(blob, "<i8", 4 * n, 4).reshape(4, n).tolist()
    text, at, term = blob[4 + 32 * n :].decode("utf-8", "surrogatepass"), 0, ""
    for k, size, o, r in zip(shared, sizes, occurrences, records, strict=True):
        term = term[:k] + text[at : at + size]
        at += size
        yield term, o, r


def merge_subtrees(blobs: list[bytes]) -> Iterator[tuple[str, int, int]]:
    """Subtrees of one route, merged in the order of their nodes; counters of one term are added."""
    rows = unpack_subtree(blobs[0]) if len(blobs) == 1 else heapq.merge(*map(unpack_subtree, blobs))
    last, o, r = None, 0, 0
    for term, occurrences, records in rows:
        if term == last:
            o, r = o + occurrences, r + records
            continue
        if last is not None:
            yield last, o, r
        last, o, r = term, occurrences, records
    if last is not None:
        yield last, o, r


_SUBTREE = pa.schema([("route", pa.string()), ("n", pa.int64()), ("subtree", pa.binary())])
_SUBTREE_DDL = "route string, n bigint, subtree binary"


def _sent(route: str, rows: Counts) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, int, int]] = []
    for row in rows:
        held.append(row)
        if len(held) == SENT_TERMS:
            yield pa.RecordBatch.from_arrays([pa.array([route]), pa.array([len(held)], pa.int64()), pa.array([pack_subtree(held)])], schema=_SUBTREE)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([route]), pa.array([len(held)], pa.int64()), pa.array([pack_subtree(held)])], schema=_SUBTREE)


def _count_rows(terms_of: Callable[[object], list[str]], spill_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                terms = terms_of(raw)
                if len(terms) == 1:
                    trie.add(terms[0], 1, 1)
                elif terms:
                    seen: dict[str, int] = {}
                    for t in terms:
                        seen[t] = seen.get(t, 0) + 1
                    for t, n in seen.items():
                        trie.add(t, n, 1)
            if trie.size > spill_terms:
                yield from _sent("", trie.items())
                trie = BurstTrie()
        yield from _sent("", trie.items())

    return run


def route_of(term: str, longer: dict[str, int]) -> str:
    """The shortest prefix of ``term`` that needs no extension; ``longer`` has the length to which others are extended."""
    route = ""
    while (size := longer.get(route)) is not None and len(route) < len(term):
        route = term[:size]
    return route


def _measure_routes(longer: dict[str, int], open_: set[str]):
    """Counts, least and greatest term of the routes below the prefixes of ``open_``."""
    schema = pa.schema([("route", pa.string()), ("n", pa.int64()), ("least", pa.string()), ("most", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                for route, rows in groupby((t for t, _, _ in unpack_subtree(blob)), lambda t: route_of(t, longer)):
                    terms = list(rows)
                    known = found.get(route)
                    if known is None:
                        found[route] = [len(terms), terms[0], terms[-1]]
                    else:
                        known[0] += len(terms)
                        known[1], known[2] = min(known[1], terms[0]), max(known[2], terms[-1])
        new = [(r, *v) for r, v in found.items() if any(r.startswith(p) for p in open_)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in new], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def adaptive_routes(partial: DataFrame, share: int) -> dict[str, int]:
    """The prefixes that hold more than ``share`` partial counts, and to which length each is extended.

    A prefix is extended beyond what all its terms share, at first by one character, then by twice
    as many each time; a route that is a whole term stays.  At most (all partial counts) / ``share``
    prefixes are open at a time, so the driver holds few.
    """
    longer, open_, step = {"": 1}, {""}, 1
    while open_:
        measured = partial.mapInArrow(_measure_routes(longer, open_), "route string, n bigint, least string, most string")
        hot = measured.groupBy("route").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).where((F.col("n") > share) & (F.col("least") != F.col("most"))).collect()
        open_ = {r.route for r in hot}
        longer |= {r.route: shared_length(r.least, r.most) + step for r in hot}
        step *= 2
    return longer


def _route(longer: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                for route, rows in groupby(unpack_subtree(blob), lambda row: route_of(row[0], longer)):
                    yield from _sent(route, rows)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of ``route``; counts leave as they are merged."""
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
    merged = (row for _, same in groupby(rows, lambda row: row[0]) for row in merge_subtrees([blob for _, blob in same]))
    while part := [row for _, row in zip(range(20_000), merged, strict=False)]:
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], f.type) for k, f in enumerate(_PARTIAL)], schema=_PARTIAL)


def count_terms(df: DataFrame, column: str, terms_of: Callable[[object], list[str]] = tags_of, spill_terms: int = 400_000) -> DataFrame:
    """``term, occurrences, records`` for every distinct term of ``column``.

    ``terms_of`` gives the terms of one value; a term counts each time in ``occurrences`` and
    once per row in ``records``.  Null, empty and malformed values have no terms; an empty table
    gives no rows.  Other columns, whatever their names, are not read.
    """
    raw = df.select(F.col(column).alias("raw"))
    partial = stage(raw.mapInArrow(_count_rows(terms_of, spill_terms), _SUBTREE_DDL), "term-partials")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = partial.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0].n
    share = max(1000, total // (4 * parts))
    longer = adaptive_routes(partial, share) if total > share else {}
    routed = partial.mapInArrow(_route(longer), _SUBTREE_DDL)
    return routed.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(_merge, _PARTIAL_DDL)


def tag_counts(images: DataFrame, column: str = "tags_json", rare_rows: int = 2, common_share: int = 10) -> DataFrame:
    """``tag, n_occurrences, n_images, mark`` for all tags of ``images``.

    mark: 'rare' for tags of at most ``rare_rows`` rows, 'common' for tags of more than one in
    ``common_share`` of all rows (rows without tags included), else 'useful'.  In a table so
    small that both hold, 'common' wins.  Null or malformed lists hold no tags.
    """
    rows = images.count()
    counts = count_terms(images, column)
    mark = F.when(F.col("records") * common_share > rows, "common").when(F.col("records") <= rare_rows, "rare").otherwise("useful")
    return counts.select(F.col("term").alias("tag"), F.col("occurrences").alias("n_occurrences"), F.col("records").alias("n_images"), mark.alias("mark"))
