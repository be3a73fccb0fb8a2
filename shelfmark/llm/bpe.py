"""Encoding a corpus with a public byte-level BPE vocabulary, by recursive queries of DuckDB.

Each task splits its texts into words with the vocabulary's pattern, gives every distinct word
of a chunk to an in-process DuckDB as token-position rows, and lets one recursive query contract
them: the rows join the merge table, each word's pair of minimum rank is replaced by its merged
token (all its occurrences from the left at once, which is what repeating the leftmost contraction
gives), until no pair of the word has a merge.  An ordered aggregation gives each word's ids, and
the texts' id lists are put together from their words.

A long word is contracted in overlapping blocks, all at once, so that it needs no round for each
of its merges.  Two blocks are joined where both end a token, if the two tokens that meet there are
what their own bytes contract to: a list of tokens is the contraction of its bytes exactly when
each two neighbours are that of theirs.  A word without such a place is taken in larger blocks,
at last whole.

A text that spells a special token is ordinary text.  Null and empty texts have the empty list.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the vocabulary files.
TOKENIZERS = os.environ.get("SHELFMARK_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct bytes of words that one recursive query contracts.
CHUNK_BYTES = 400_000
#: Bytes of a block of a longer word; half as many more overlap the next block.
LONG_BYTES = 64
#: Bytes of words whose ids a worker remembers.
REMEMBERED_BYTES = 16_000_000

# Rows whose word has no merge left leave the recursion with live = false.  In a run of adjacent
# hits (as in 'aaaa') every second one counts, from the left: 'run' is a hit's place in its run.
_CONTRACT = """
WITH RECURSIVE step(word, pos, tok, live) AS (
  SELECT word, pos, tok, true FROM letters
  UNION ALL
  (WITH paired AS (
     SELECT s.word, s.pos, s.tok, m.rank, m.merged,
            min(m.rank) OVER (PARTITION BY s.word) AS best
     FROM (SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS after FROM step WHERE live) s
     LEFT JOIN merges m ON m.a = s.tok AND m.b = s.after),
   hits AS (
     SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) AS k, coalesce(rank = best, false) AS hit FROM paired),
   runs AS (
     SELECT *, k - max(CASE WHEN hit THEN 0 ELSE k END) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM hits),
   marked AS (SELECT *, hit AND run % 2 = 1 AS joins FROM runs),
   moved AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM marked)
   SELECT word, pos, CASE WHEN joins THEN merged ELSE tok END, best IS NOT NULL FROM moved WHERE NOT gone))
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY word ORDER BY word
"""


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """A vocabulary with its merge table in an in-process DuckDB."""

    def __init__(self, path: str) -> None:
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        to_byte = {x: b for b, x in letters.items()}
        self.bytes = {k: bytes(to_byte[x] for x in token) for token, k in vocab.items() if all(x in to_byte for x in token)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = pa.table({"a": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "b": pa.array([vocab[b] for _, b in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int32()), "merged": pa.array([vocab[a + b] for a, b in pairs], pa.int32())})
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for k, b in self.bytes.items():
            self.size[k] = len(b)
        self.split = regex.compile(PATTERN).findall
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "384MB", "preserve_insertion_order": False})
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.unregister("merges_in")
        self.known: dict[str, np.ndarray] = {}
        self.known_bytes = 0

    def learn(self, words: set[str]) -> None:
        """Find the ids of all words not yet known."""
        new = {w: w.encode("utf-8", "surrogatepass") for w in words if w not in self.known}
        short = {w: raw for w, raw in new.items() if len(raw) <= 2 * LONG_BYTES}
        self.known.update(zip(short, self.contract(list(short.values())), strict=True))
        long = {w: raw for w, raw in new.items() if len(raw) > 2 * LONG_BYTES}
        self.known.update(zip(long, self._contract_long(list(long.values())), strict=True))
        self.known_bytes += sum(len(raw) + 100 for raw in new.values())

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each of ``words``, chunk by chunk."""
        out: list[np.ndarray] = []
        start = size = 0
        for k, raw in enumerate(words):
            if k > start and size + len(raw) > CHUNK_BYTES:
                out += self._contract(words[start:k])
                start, size = k, 0
            size += len(raw)
        return out + self._contract(words[start:]) if words else out

    def _contract(self, chunk: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(raw) for raw in chunk])
        ends = np.cumsum(lengths)
        rows = {
            "word": np.repeat(np.arange(len(chunk), dtype=np.int32), lengths),
            "pos": (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32),
            "tok": self.first[np.frombuffer(b"".join(chunk), np.uint8)],
        }
        self.db.register("letters", pa.table(rows))
        found = self.db.sql(_CONTRACT).to_arrow_table().combine_chunks()
        self.db.unregister("letters")
        ids = found.column("ids").combine_chunks()
        return np.split(ids.values.to_numpy(zero_copy_only=False).astype(np.int32), ids.offsets.to_numpy()[1:-1])

    def _contract_long(self, words: list[bytes]) -> list[np.ndarray]:
        out: dict[int, np.ndarray] = {}
        block = LONG_BYTES
        while open_ := [k for k in range(len(words)) if k not in out]:
            whole = [k for k in open_ if len(words[k]) <= 2 * block]
            out.update(zip(whole, self.contract([words[k] for k in whole]), strict=True))
            cut = {k: [(s, words[k][s : s + block + block // 2]) for s in range(0, len(words[k]), block)] for k in open_ if len(words[k]) > 2 * block}
            distinct = list({raw for pieces in cut.values() for _, raw in pieces})
            ids = dict(zip(distinct, self.contract(distinct), strict=True))
            ends = {raw: np.cumsum(self.size[x]) for raw, x in ids.items()}
            # per pair of blocks: the places where both end a token, with the tokens that meet there
            meet: dict[int, list[list[tuple[int, int, int]]]] = {}
            for k, pieces in cut.items():
                meet[k] = []
                for (s, left), (t, right) in zip(pieces, pieces[1:], strict=False):
                    after = {t: 0} | {t + int(e): j + 1 for j, e in enumerate(ends[right][:-1])}
                    meet[k].append([(s + int(e), int(ids[left][i]), int(ids[right][after[s + int(e)]])) for i, e in enumerate(ends[left]) if s + int(e) in after])
            pairs = list({(a, b) for places in meet.values() for x in places for _, a, b in x})
            fits = {p for p, x in zip(pairs, self.contract([self.bytes[a] + self.bytes[b] for a, b in pairs]), strict=True) if x.tolist() == list(p)}
            for k, pieces in cut.items():
                joints = [next((p for p, a, b in x if (a, b) in fits), None) for x in meet[k]]
                if None in joints:
                    continue
                edges = [0, *joints, len(words[k])]
                parts = []
                for (s, raw), a, b in zip(pieces, edges, edges[1:], strict=False):
                    place = s + ends[raw]
                    parts.append(ids[raw][(place > a) & (place <= b)])
                out[k] = np.concatenate(parts)
            block *= 4
        return [out[k] for k in range(len(words))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.split(t) if t else [] for t in texts]
        if self.known_bytes > REMEMBERED_BYTES:
            self.known.clear()
            self.known_bytes = 0
        self.learn({w for words in split for w in words})
        none = np.zeros(0, np.int32)
        return [np.concatenate([self.known[w] for w in words]) if words else none for words in split]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[k] for k in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def _slices(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch, each of about ``most`` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode(path: str, lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _slices(texts, 2_000_000):
                ids = coder.encode(texts[a:b])
                lengths = np.array([len(x) for x in ids], np.int64)
                if lengths_only:
                    out = pa.array(lengths, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), out], names=["key", "ids"])

    return run


def encode_corpus(df: DataFrame, id_column: str, text_column: str, vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """``<id_column>, ids``: one row per row of ``df``, repeated rows included.

    ids is the list of token ids of the whole text without special tokens; null and empty texts
    have the empty list, and an empty table gives no rows.  A null id stays null.  Columns other
    than the two named are not read.
    """
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_encode(f"{folder}/{vocabulary}", False), f"key {kind}, ids array<int>").withColumnRenamed("key", id_column)


def count_tokens(df: DataFrame, id_column: str, text_column: str, vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """``<id_column>, n_tokens`` by the same encoding; 0 for null and empty texts."""
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_encode(f"{folder}/{vocabulary}", True), f"key {kind}, ids bigint").toDF(id_column, "n_tokens")
