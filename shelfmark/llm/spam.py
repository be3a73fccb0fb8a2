"""Keyword-stuffed and link-list pages, by bagged decision trees on weak labels.

1. Content and link features of every text (``page_features``).
2. Rules that are right when they speak give seed labels; the rest of the pages stays unlabelled.
3. Word counts of all seed-labelled pages give each word a log-odds of spam; with the shares of
   such words the rules speak about more pages.  These are the weak labels.
4. Bagged trees are fitted on a bounded sample of weakly labelled pages and score every page.
5. A host's smoothed rate of spam pages shifts the log-odds of its pages, by a weight that is
   fitted on the sample with scores of trees that have not seen the page.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage

#: Most weakly labelled pages that the trees are fitted on.
SAMPLE = 20_000
#: Up to so many words with a log-odds are sent to the workers; more are joined by shuffle, with equal features.
SENT_WORDS = 20_000

# Frequent function words of the languages of the library.
_FUNCTION = frozenset(
    """a an and are as at be been but by for from had has have he her his i if in is it its just not of on or our she so that the their there they this
    to was we were what when where which while who with you your
    auf aus das dem den der des die ein eine einem einen einer er es hat ich im in ist mit neben nicht noch oder sich sie sind und vom von vor war wir zu zum zur
    au aux avec ce cette dans de des du elle en est et il la le les mais ne on ou par pas pour que qui sa se son sous sur un une
    al como con de del desde el ella en es esta este la las lo los más no para pero por que se su un una y
    ao aos as com da das do dos e em mas na nas no nos o os ou para pelo que se sem seu sua um uma""".split()
)
_URL = regex.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/\S*|\b[\w-]{2,}(?:\.[\w-]+)*\.[a-z]{2,}(?=[\s|,;·)\]]|$)", regex.I)
_HASHTAG = re.compile(r"(?<!\S)#\S+")
_LINKED = re.compile(r"://|www\.\S|[\w-]\.[A-Za-z\u017f\u212a]{2}", re.I)
_DIGIT = re.compile(r"\d")
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:['-][A-Za-z]+)*|[0-9]+")
_WORD = regex.compile(r"[\p{Hiragana}]+|[\p{Katakana}ー]+|[\p{Han}]+|[\p{L}\p{M}]+(?:['’-]\p{L}+)*|\p{N}+")
_LATIN_END = regex.compile(r"[.!?。！？…]+(?=\s|$|[\p{Han}\p{Hiragana}\p{Katakana}])|\n")
_END = regex.compile(r"[.!?。！？…]+(?=\s|$|[\p{Han}\p{Hiragana}\p{Katakana}])")
_SEPARATOR = re.compile(r"[|·•/,;、\n]| - ")

FEATURES = (
    "url_share", "hashtag_share", "repeated_share", "top_phrase_share", "function_share", "sentence_share", "separators_per_word", "title_share", "digit_share",
    "words_per_segment", "compression", "log_words", "distinct_share", "hot_word_share", "hot_word_mean", "hot_text_share", "ends_per_word", "stuffed_share",
)


def _words(text: str) -> list[str]:
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def _told(words: list[str], latin: bool) -> int:
    """How many words are function words; runs of Hiragana count as such."""
    own = sum(map(_FUNCTION.__contains__, words))
    return own if latin else own + sum("\u3041" <= w[0] <= "\u309f" for w in words)


class Page:
    """What the features of a text are computed from; the text is split into words once."""

    __slots__ = ("bare", "letters", "links", "segments", "tags", "text")

    def __init__(self, text: str) -> None:
        self.text = text
        self.letters = len("".join(text.split()))
        bare, self.links, self.tags = text, 0, 0
        if "." in text and _LINKED.search(text):
            rest = _URL.split(text)
            self.links = len(text) - sum(map(len, rest))
            bare = " ".join(rest)
        if "#" in text:
            self.tags = sum(map(len, _HASHTAG.findall(bare)))
        self.bare = bare
        untagged = _HASHTAG.sub(" ", bare) if self.tags else bare
        # (size, words, words in lower case) of each stretch between sentence ends
        self.segments = [(len(x), w, " ".join(w).lower().split(" ") if w else w) for x in _LATIN_END.split(untagged) if x and not x.isspace() for w in (_words(x),)]
        self.bare = untagged

    def words(self) -> set[str]:
        """Distinct words without links; hash tags count as words."""
        found = {w for _, _, own in self.segments for w in own}
        if self.tags:
            found.update(w.lower() for t in _HASHTAG.findall(self.text) for w in _words(t))
        return found

    def plain(self) -> list[float]:
        """The features that need no word odds."""
        n = max(self.letters, 1)
        words = [w for _, own, _ in self.segments for w in own]
        lower = [w for _, _, own in self.segments for w in own]
        k = len(lower)
        d = max(k, 1)
        firsts = [w[0] for w in lower]
        named = [w for w, digit in zip(lower, map(str.isdigit, firsts), strict=True) if not digit]  # numbers repeat in tables and time marks
        pairs = Counter(zip(named, named[1:], strict=False))
        often = {p for p, c in pairs.items() if c >= 3}
        covered = 0
        if often:
            last = False
            for p in zip(named, named[1:], strict=False):
                now = p in often
                covered += now or last
                last = now
            covered += last
        latin = self.text.isascii()
        told = [_told(own, latin) for _, _, own in self.segments]
        sentences = sum(size for (size, own, _), t in zip(self.segments, told, strict=True) if len(own) >= 3 and t >= 0.15 * len(own))
        long = max(sum(size for size, _, _ in self.segments), 1)
        raw = self.text.encode("utf-8", "replace")
        return [
            min(self.links / n, 1.0), min(self.tags / n, 1.0), covered / d, max(pairs.values(), default=0) * 2 / d, sum(told) / d, sentences / long,
            len(_SEPARATOR.findall(self.bare)) / d, sum(map(str.isupper, [w[0] for w in words])) / d, len(_DIGIT.findall(self.bare)) / n,
            k / max(len(self.segments), 1), len(zlib.compress(raw, 1)) / len(raw), math.log1p(k), len(pairs) / d,
        ]

    def ends(self) -> float:
        return len(_END.findall(self.bare)) / max(sum(len(own) for _, own, _ in self.segments), 1)

    def hot(self, odds: dict[str, float]) -> list[float]:
        """The features from the spam log-odds of words."""
        marks = [[m for w in own if (m := odds.get(w)) is not None] for _, _, own in self.segments]
        sizes, counts = [size for size, _, _ in self.segments], [len(own) for _, _, own in self.segments]
        return hot_features(sizes, counts, [len(m) for m in marks], [sum(m) for m in marks], self.links + self.tags, self.ends())


def hot_features(sizes: list[int], counts: list[int], telling: list[int], totals: list[float], stuffed: float, ends: float) -> list[float]:
    """The features from the spam log-odds of words, by the size, words, telling words and sum of odds of each segment."""
    hot = sum(size for size, n, t in zip(sizes, counts, telling, strict=True) if n and t >= 0.25 * n)
    k, long = max(sum(counts), 1), max(sum(sizes), 1)
    return [sum(telling) / k, sum(totals) / k, hot / long, ends, (hot + stuffed) / max(sum(sizes) + stuffed, 1)]


def page_features(text: str | None, odds: dict[str, float]) -> list[float]:
    """The features of a text; ``odds`` has the spam log-odds of words and may be empty.  Null and blank texts have zeros."""
    if not text or text.isspace():
        return [0.0] * len(FEATURES)
    page = Page(text)
    return page.plain() + page.hot(odds)


_F = {name: k for k, name in enumerate(FEATURES)}


def seed_label(x: np.ndarray) -> np.ndarray:
    """1 spam, 0 none, -1 no opinion, from the features that need no word odds."""
    names = ("url_share", "hashtag_share", "repeated_share", "function_share", "sentence_share", "log_words", "ends_per_word", "digit_share")
    url, tags, rep, fun, sent, words, ends, digits = (x[:, _F[n]] for n in names)
    # menus, recipes and price lists repeat words too, but every line has its number
    listed = (rep > 0.6) & (fun < 0.25) & (ends < 0.02) & (digits < 0.03) & (words > math.log1p(14))
    linked = (url > 0.6) | ((tags > 0.6) & (words > -1))
    plain = (url < 0.05) & (tags < 0.02) & (((fun > 0.2) & (sent > 0.8)) | ((rep < 0.05) & (words > -1)))
    return np.where(listed | linked, 1, np.where(plain, 0, -1))


def weak_label(x: np.ndarray) -> np.ndarray:
    """1 spam, 0 none, -1 no opinion, with the shares of words that spam pages use."""
    seed = seed_label(x)
    stuffed, words = x[:, _F["stuffed_share"]], x[:, _F["hot_word_share"]]
    spam = (stuffed > 0.65) | (seed == 1)
    clean = (seed != 1) & (stuffed < 0.45) & (words < 0.12) & ((x[:, _F["repeated_share"]] < 0.6) | (x[:, _F["digit_share"]] > 0.05))
    return np.where(spam, 1, np.where(clean, 0, -1))


class Tree:
    """A decision tree on binned features with Gini splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int, rng: np.random.Generator, depth: int = 6, least: int = 8) -> None:
        self.nodes: list[tuple] = []
        self._grow(x, y, np.arange(len(y)), bins, rng, depth, least)

    def _grow(self, x, y, rows, bins, rng, depth, least) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        n, ones = len(rows), float(y[rows].sum())
        best = (0.0, -1, -1)
        if depth and n >= 2 * least and 0 < ones < n:
            whole = 2 * ones * (n - ones) / n
            for f in rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]:
                count = np.bincount(x[rows, f], minlength=bins).cumsum()[:-1].astype(float)
                hits = np.bincount(x[rows, f], weights=y[rows], minlength=bins).cumsum()[:-1]
                ok = (count >= least) & (n - count >= least)
                if ok.any():
                    c, h = count[ok], hits[ok]
                    gain = whole - 2 * h * (c - h) / c - 2 * (ones - h) * ((n - c) - (ones - h)) / (n - c)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), int(f), int(np.flatnonzero(ok)[k]))
        if best[1] < 0:
            self.nodes[at] = (-1, 0, 0, 0, (ones + 0.5) / (n + 1))
            return at
        left = x[rows, best[1]] <= best[2]
        a = self._grow(x, y, rows[left], bins, rng, depth - 1, least)
        b = self._grow(x, y, rows[~left], bins, rng, depth - 1, least)
        self.nodes[at] = (best[1], best[2], a, b, 0.0)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            f, cut, a, b, value = self.nodes[at]
            if f < 0:
                out[rows] = value
            elif len(rows):
                left = x[rows, f] <= cut
                stack += [(a, rows[left]), (b, rows[~left])]
        return out


class Forest:
    """Trees on bootstrap samples; a page's probability is the mean of their leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, bins: int = 48, seed: int = 7) -> None:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(x)
        rng = np.random.default_rng(seed)
        self.trees = []
        total, unseen = np.zeros(len(y)), np.zeros(len(y))
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(binned[rows], y[rows], bins, rng))
            out = np.setdiff1d(np.arange(len(y)), rows)
            total[out] += self.trees[-1].predict(binned[out])
            unseen[out] += 1
        #: The mean of the trees that have not seen the page; one half where all have.
        self.held_out = np.divide(total, unseen, out=np.full(len(y), 0.5), where=unseen > 0)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = self._bin(x)
        return np.mean([t.predict(binned) for t in self.trees], axis=0)


_SPLIT = pa.schema([
    ("plain", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("stuffed", pa.float64()), ("ends", pa.float64()), ("words", pa.list_(pa.string())), ("tags", pa.string()), ("seed", pa.int32()),
])
_SPLIT_DDL = "plain array<double>, sizes array<bigint>, counts array<bigint>, stuffed double, ends double, words array<string>, tags string, seed int"


def _split_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: id, host, text; out: what the features are made of, the words of each segment and of the hash tags joined by blanks, and the seed label.

    Null and blank texts have none of them.
    """
    for batch in batches:
        pages = [Page(t) if t and not t.isspace() else None for t in batch.column(2).to_pylist()]
        plain = [p.plain() if p else None for p in pages]
        ends = [p.ends() if p else None for p in pages]
        seed = seed_label(np.array([x + [0.0, 0.0, 0.0, e, 0.0] if x else [0.0] * len(FEATURES) for x, e in zip(plain, ends, strict=True)], float).reshape(len(pages), len(FEATURES)))
        made = [
            plain, *([f(p) if p else None for p in pages] for f in (lambda p: [x[0] for x in p.segments], lambda p: [len(x[2]) for x in p.segments], lambda p: float(p.links + p.tags))), ends,
            *([f(p) if p else None for p in pages] for f in (
                lambda p: [" ".join(x[2]) for x in p.segments], lambda p: " ".join(w.lower() for t in _HASHTAG.findall(p.text) for w in _words(t)) if p.tags else "",
            )), [int(k) if p else None for k, p in zip(seed, pages, strict=True)],
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, f.type) for x, f in zip(made, _SPLIT, strict=True))], names=["id", "host", *_SPLIT.names])


def _seed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: seed, words, tags.  Per task: in how many spam and clean seed pages each word occurs."""
    counts: dict[str, list[int]] = {}
    pages = [0, 0]

    def emit() -> pa.RecordBatch:
        keys = list(counts)
        values = list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array([*keys, None], pa.string()), pa.array([*(v[1] for v in values), pages[1]], pa.int64()), pa.array([*(v[0] for v in values), pages[0]], pa.int64())], names=["word", "spam", "clean"])

    for batch in batches:
        for label, words, tags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pages[label] += 1
            for w in {w for part in (*words, tags) for w in part.split(" ")}:
                if w:
                    counts.setdefault(w, [0, 0])[label] += 1
        if len(counts) > 300_000:
            yield emit()
            counts.clear()
            pages = [0, 0]
    yield emit()


def split_pages(pages: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """``id, host`` and what the features are made of; every text is split once."""
    kind = pages.schema[id_column].dataType.simpleString()
    rows = pages.select(F.col(id_column).alias("id"), F.col(host_column).cast("string").alias("host"), F.col(text_column).cast("string").alias("text"))
    return stage(rows.mapInArrow(_split_pages, f"id {kind}, host string, {_SPLIT_DDL}"), "spam-split")


def word_odds(split: DataFrame) -> DataFrame | None:
    """``word, odds``: the spam log-odds of all words that tell spam from clean seed pages, over all pages of ``split_pages``.

    Words in fewer than three spam pages are left out.  Odds are multiples of 2 ** -20, so that
    sums of them are the same in any order.  None where no page is spam to the seed rules.
    """
    counted = split.where("seed >= 0").select("seed", "words", "tags").mapInArrow(_seed_words, "word string, spam bigint, clean bigint")
    counted = stage(counted.groupBy("word").agg(F.sum("spam").alias("spam"), F.sum("clean").alias("clean")), "spam-words")
    totals = counted.where(F.col("word").isNull()).collect()
    if not totals or not totals[0].spam:
        return None
    spam, clean = totals[0].spam, totals[0].clean or 0
    odds = F.log((F.col("spam") + 0.5) / (spam + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    rows = counted.where(F.col("word").isNotNull() & (F.col("spam") >= 3)).withColumn("odds", F.round(odds * 1048576) / 1048576)
    return rows.where(F.col("odds") > 1).select("word", "odds")


def _join_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: id, host, plain, sizes, counts, stuffed, ends, marks; out: as of ``_measure_pages``."""
    for batch in batches:
        rows = []
        for plain, sizes, counts, stuffed, ends, marks in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
            if plain is None:
                rows.append(None)
                continue
            telling, totals = [0] * len(sizes), [0.0] * len(sizes)
            for m in marks or ():
                telling[m["segment"]], totals[m["segment"]] = m["telling"], m["total"]
            rows.append(plain + hot_features(sizes, counts, telling, totals, stuffed, ends))
        yield _measured_batch(batch.column(0), batch.column(1), rows)


def _measured_batch(ids: pa.Array, hosts: pa.Array, rows: list[list[float] | None]) -> pa.RecordBatch:
    x = np.array([r or [0.0] * len(FEATURES) for r in rows], float).reshape(len(rows), len(FEATURES))
    label = np.where([r is not None for r in rows], weak_label(x), -1) if rows else np.zeros(0)
    return pa.RecordBatch.from_arrays([ids, hosts, pa.array(label, pa.int32()), pa.array(rows, pa.list_(pa.float32()))], names=["id", "host", "label", "x"])


def measure_pages(split: DataFrame, words: DataFrame | None, sent: int = SENT_WORDS) -> DataFrame:
    """``id, host, label, x`` of the rows of ``split_pages``: the weak label and the features, none for null and blank texts.

    Up to ``sent`` words are sent to the workers, more are joined to the words of the pages.
    """
    kind = split.schema["id"].dataType.simpleString()
    schema = f"id {kind}, host string, label int, x array<float>"
    few = words.limit(sent + 1).collect() if words is not None else []
    if len(few) <= sent:
        columns = ["id", "host", "plain", "sizes", "counts", "stuffed", "ends", "words"]
        return split.select(*columns).mapInArrow(_mark_words({r.word: r.odds for r in few}), schema)
    keyed = stage(split.drop("tags", "seed").withColumn("key", F.monotonically_increasing_id()), "spam-keys")  # keys are fixed from here
    own = keyed.select("key", F.posexplode("words").alias("segment", "joined")).select("key", "segment", F.explode(F.split("joined", " ")).alias("word"))
    sums = own.join(words, "word").groupBy("key", "segment").agg(F.count("*").alias("telling"), F.sum("odds").alias("total"))
    marks = sums.groupBy("key").agg(F.collect_list(F.struct("segment", "telling", "total")).alias("marks"))
    joined = keyed.drop("words").join(marks, "key", "left").select("id", "host", "plain", "sizes", "counts", "stuffed", "ends", "marks")
    return joined.mapInArrow(_join_marks, schema)


def _mark_words(odds: dict[str, float]):
    """As ``_join_marks``, with the words of each segment instead of marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for plain, sizes, counts, stuffed, ends, words in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
                if plain is None:
                    rows.append(None)
                    continue
                marks = [[m for w in part.split(" ") if (m := odds.get(w)) is not None] for part in words]
                rows.append(plain + hot_features(sizes, counts, [len(m) for m in marks], [sum(m) for m in marks], stuffed, ends))
            yield _measured_batch(batch.column(0), batch.column(1), rows)

    return run


def _score_pages(forest: Forest | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            there = np.array([r is not None for r in rows], bool)
            p = np.zeros(len(rows))
            if there.any():
                x = np.array([r for r in rows if r is not None], float)
                p[there] = forest.predict(x) if forest else np.maximum(x[:, _F["url_share"]], x[:, _F["hashtag_share"]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], names=["id", "host", "page_score"])

    return run


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_host_weight(page: np.ndarray, shift: np.ndarray, label: np.ndarray) -> float:
    """The weight of a host's log-odds beside a page's own that tells the labels best, between 0 and 1, in steps of 1/20."""
    loss = []
    for k in range(21):
        z = _logit(page) + k / 20 * shift
        loss.append(np.logaddexp(0, np.where(label > 0, -z, z)).mean())
    return int(np.argmin(loss)) / 20


def score_pages(pages: DataFrame, id_column: str, text_column: str, host_column: str, sample: int = SAMPLE, prior: float = 20.0) -> DataFrame:
    """``<id_column>, page_score, host_rate, score``: one row per row of ``pages``.

    ``page_score`` is the trees' probability of the text alone.  ``host_rate`` is the host's rate
    of pages above one half, smoothed towards the rate of all pages by ``prior`` pages; ``score``
    shifts the page's log-odds by a fitted weight times that of the host against all.  Null, empty
    and blank texts score 0; pages without a host keep their own score; where no page looks like
    spam to the rules, the share of links and tags is the score.  An empty table gives no rows.
    """
    kind = pages.schema[id_column].dataType.simpleString()
    split = split_pages(pages, id_column, text_column, host_column)
    measured = stage(measure_pages(split, word_odds(split)), "spam-features")
    weak = measured.where("label >= 0").select("id", "host", "label", "x")
    # a sample that is the same on any cluster: the first ones by a hash of their ids
    rows = [r for label in (0, 1) for r in weak.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id", "x").limit(sample // 2).select("host", "label", "x").collect()]
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    forest = Forest(x, y) if rows and 0 < y.sum() < len(y) else None
    scored = stage(measured.select("id", "host", "x").mapInArrow(_score_pages(forest), f"id {kind}, host string, page_score double"), "spam-scores")
    total = scored.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("page_score") > 0.5).cast("int")), F.lit(0)).alias("spam")).collect()[0]
    base = (total.spam + 1) / (total.n + 2)
    hosts = scored.where("host is not null").groupBy("host").agg(((F.sum((F.col("page_score") > 0.5).cast("int")) + base * prior) / (F.count("*") + prior)).alias("host_rate"))
    logit = lambda c: F.log(c / (1 - c))
    hosts = hosts.withColumn("shift", logit(F.col("host_rate")) - math.log(base / (1 - base)))
    host_weight = 0.0
    if forest:
        known = pages.sparkSession.createDataFrame([(r.host, float(p), int(r.label)) for r, p in zip(rows, forest.held_out, strict=True)], "host string, page double, label int")
        seen = known.join(hosts, "host").select("page", "shift", "label").collect()  # at most ``sample`` rows
        if seen:
            host_weight = fit_host_weight(*(np.array([r[k] for r in seen]) for k in range(3)))
    held = F.least(F.greatest("page_score", F.lit(1e-6)), F.lit(1 - 1e-6))
    shift = F.coalesce("shift", F.lit(0.0)) * host_weight
    score = F.when(F.col("page_score") == 0, 0.0).otherwise(1 / (1 + F.exp(-(logit(held) + shift))))
    return scored.join(hosts, "host", "left").select(F.col("id").alias(id_column), "page_score", "host_rate", score.alias("score"))
