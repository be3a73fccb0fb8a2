"""Abusive, hateful or sexual content: a character n-gram linear classifier with naive Bayes scaled features.

A text is made comparable (look-alike letters, leet digits, spaced or stretched letters), then
seen through windows of a fixed number of characters that slide over the whole text, because an
attack may be one sentence of a long text.  The features of a window are its hashed character
n-grams; each is scaled by the log-count ratio of naive Bayes, and a logistic regression on the
scaled features gives the weights.  As a window's score is the sum of the weights at its
positions, all windows of a batch are scored by one cumulative sum.  The text's score is that of
its worst window.

Training uses labelled texts only, in one task, so that the driver gets a model of fixed size
whatever the texts.  Of a text with a bad label only the worst windows are bad, which is found in
rounds: score the windows with what is known, take each text's worst ones, fit anew.
Labels that held-out models contradict firmly are set aside, and the threshold is the one that
does best on held-out labelled texts at the rate of bad texts among all that are scored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage

#: Characters of a window, lengths of the n-grams, bits of a hashed n-gram.
WINDOW, ORDERS, BITS = 80, (3, 4, 5), 19
#: Most labelled texts that the classifier is fitted on, of either kind.
SAMPLE_BAD, SAMPLE_GOOD = 1000, 4000
#: Windows that are held of a bad text, the worst of all.
WORST = 16
#: The log-odds from which a text counts as bad when their rate is estimated.
COUNTED = 2.0
BAD_LABELS = ("abusive", "hateful", "sexual")

# Letters of other scripts that look like Latin ones, and digits read as letters.
_LOOKS = str.maketrans("аеорсухіјѕһԁԛԝвкмнтгαερουικντг", "aeopcyxijshdqwbkmhtraepouikvtr")
_LEET = str.maketrans("0134578@$!", "oieastbasi")
_MIXED = re.compile(r"(?=\w*[a-z])(?=\w*[Ͱ-ϿЀ-ӿ])\w+")
_LEETED = re.compile(r"(?<![\w@$])(?=[\w@$!]*[a-z])(?=[\w@$]*[0134578@$])[a-z0134578@$]{3,}(?![\w@$])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?!\w)")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_FORMAT = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")


def comparable(text: str | None) -> str:
    """Lower case without accents, invisible characters and the usual disguises of words."""
    if not text:
        return ""
    if text.isascii():
        s = text.lower()
    else:
        s = unicodedata.normalize("NFKD", _FORMAT.sub("", text)).casefold()
        s = "".join(c for c in s if not unicodedata.combining(c))
        s = _MIXED.sub(lambda m: m[0].translate(_LOOKS), s)
    s = _LEETED.sub(lambda m: m[0].translate(_LEET), s)
    s = _STRETCHED.sub(r"\1", s)
    s = _SPACED.sub(lambda m: "".join(c for c in m[0] if c.isalpha()), s)
    return _SPACE.sub(" ", _DIGITS.sub("0", s)).strip()


_MULTIPLIER = np.uint32(2654435761)


def ngram_buckets(text: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each position of an array of code points."""
    n = max(len(text) - order + 1, 0)
    h = np.full(n, order, np.uint32)
    for k in range(order):
        h = (h ^ text[k : k + n]) * np.uint32(16777619)
    return ((h * _MULTIPLIER) >> np.uint32(32 - BITS)).astype(np.int32)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each in blanks and followed by a break of WINDOW zeros; the starts of the texts."""
    gap = "\0" * WINDOW
    lengths = np.array([len(t) + 2 + WINDOW for t in texts])
    joined = "".join(f" {t} {gap}" for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


class Model:
    """Weights by bucket, a bias, the threshold of a case, and the held-out scores and labels it is taken from."""

    def __init__(self, weights: np.ndarray, bias: float, threshold: float, held: np.ndarray | None = None, label: np.ndarray | None = None) -> None:
        self.weights, self.bias, self.threshold = weights.astype(np.float32), float(bias), float(threshold)
        self.held, self.label = held, label

    def threshold_at(self, bad: int, n: int) -> float:
        """The threshold where ``bad`` of ``n`` texts look bad."""
        if self.held is None or not n:
            return self.threshold
        return _best_threshold(self.held, self.label, (bad + 0.5) / (n + 1))

    def window_scores(self, points: np.ndarray) -> np.ndarray:
        """The score of the window that starts at each position; n-grams that touch a break weigh nothing."""
        n = len(points)
        at = np.zeros(n, np.float32)
        broken = points == 0
        for order in ORDERS:
            w = self.weights[ngram_buckets(points, order)]
            bad = broken[: len(w)].copy()
            for k in range(1, order):
                bad |= broken[k : k + len(w)]
            w[bad] = 0
            at[: len(w)] += w
        total = np.concatenate([[0.0], np.cumsum(at, dtype=np.float64)])
        ends = np.minimum(np.arange(n) + WINDOW, n)
        score = total[ends] - total[:-1]
        # a window lies within its text, or is the whole of a shorter one
        first = np.concatenate([[True], broken[:-1]])
        score[broken | (broken[np.minimum(ends - 1, n - 1)] & ~first)] = -np.inf
        return score

    def scores(self, texts: list[str]) -> np.ndarray:
        """The log-odds of each text's worst window; texts are joined up to a million characters at a time."""
        out, start, size = [np.zeros(0)], 0, 0
        for k, t in enumerate(texts):
            size += len(t) + WINDOW + 2
            if size > 1_000_000 or k + 1 == len(texts):
                points, starts = _points(texts[start : k + 1])
                out.append(np.maximum.reduceat(self.window_scores(points), starts[:-1]) + self.bias)
                start, size = k + 1, 0
        return np.concatenate(out)


def _window_starts(n: int, step: int = WINDOW // 4) -> np.ndarray:
    """Starts of the windows of a text of ``n`` code points, ``step`` apart; the last ends with the text."""
    starts = np.arange(0, max(n - WINDOW, 0) + 1, step)
    return np.append(starts, n - WINDOW) if n > WINDOW and starts[-1] + WINDOW < n else starts


class _Windows:
    """Windows of texts as lists of buckets.

    Windows of a bad text are a quarter of a window apart; of one with more than WORST so many are
    held, first by lot, until ``choose`` takes the worst of all.  Those of other texts follow each
    other so closely that every n-gram lies in one, and all are held.
    """

    def __init__(self, texts: list[str], bad: np.ndarray, rng: np.random.Generator) -> None:
        owner, rows = [], []
        self.long: dict[int, str] = {}
        self.first: dict[int, int] = {}
        for k, t in enumerate(texts):
            points = self._text_points(t)
            starts = _window_starts(len(points)) if bad[k] else _window_starts(len(points), WINDOW - max(ORDERS) + 1)
            if bad[k] and len(starts) > WORST:
                starts = np.sort(rng.choice(starts, WORST, replace=False))
                self.long[k], self.first[k] = t, len(rows)
            for s in starts:
                part = points[s : s + WINDOW]
                owner.append(k)
                rows.append(np.concatenate([ngram_buckets(part, o) for o in ORDERS]))
        self.owner = np.array(owner, np.int64)
        self.lot = rng.random(len(owner))
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    @staticmethod
    def _text_points(text: str) -> np.ndarray:
        return np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How often each bucket occurs in the chosen windows."""
        out = np.zeros(1 << BITS, np.int64)
        for at in range(0, len(rows), 8192):
            out += np.bincount(self.take(rows[at : at + 8192])[0], minlength=1 << BITS)
        return out

    def all_counts(self, texts: np.ndarray) -> np.ndarray:
        """How often each bucket occurs in all windows of the long bad ones of ``texts``."""
        out = np.zeros(1 << BITS, np.int64)
        for k in np.intersect1d(texts, list(self.long)):
            points = self._text_points(self.long[k])
            starts = _window_starts(len(points))
            for order in ORDERS:
                buckets = ngram_buckets(points, order)
                # in how many windows the n-gram at each position lies
                within = np.zeros(len(buckets) + 1, np.int64)
                np.add.at(within, starts, 1)
                np.add.at(within, starts + WINDOW - order + 1, -1)
                out += np.bincount(buckets, weights=np.cumsum(within)[:-1], minlength=1 << BITS).astype(np.int64)
        return out

    def choose(self, weights: np.ndarray, texts: np.ndarray) -> None:
        """Hold the worst windows of each long bad one of ``texts``, out of all its windows."""
        weights = weights.astype(np.float32)
        for k in np.intersect1d(texts, list(self.long)):
            points = self._text_points(self.long[k])
            starts = _window_starts(len(points))
            buckets = [ngram_buckets(points, o) for o in ORDERS]
            score = np.zeros(len(starts))
            for order, b in zip(ORDERS, buckets, strict=True):
                total = np.concatenate([[0.0], np.cumsum(weights[b], dtype=np.float64)])
                score += total[starts + WINDOW - order + 1] - total[starts]
            worst = starts[np.sort(np.argsort(-score, kind="stable")[:WORST])]
            rows = np.concatenate([b[s : s + WINDOW - o + 1] for s in worst for o, b in zip(ORDERS, buckets, strict=True)])
            at = self.starts[self.first[k]]
            self.flat[at : at + len(rows)] = rows

    def score(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights.astype(np.float32)[self.flat], self.starts).astype(np.float64)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the chosen windows and the place of the window each belongs to."""
        sizes = self.sizes[rows]
        place = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        shift = (self.starts[rows] - (np.cumsum(sizes) - sizes)).astype(np.int32)  # a bounded sample: int32 is enough
        return self.flat[np.arange(len(place), dtype=np.int32) + shift[place]], place


#: Parts of the labelled texts that are held out in turn.
FOLDS = 4
#: The log-odds of a window without evidence.
PRIOR = -2.0


def _ratios(p: np.ndarray, q: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket from its counts in bad and other windows; 0 for buckets not seen."""
    ratio = np.log((p + alpha) / (p + alpha).sum()) - np.log((q + alpha) / (q + alpha).sum())
    ratio[p + q == 0] = 0
    return ratio


def _fit(flat: np.ndarray, place: np.ndarray, y: np.ndarray, ratio: np.ndarray, steps: int = 60, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression on the scaled features, by Adam; returns the weights of plain counts."""
    n = len(y)
    used, inner = np.unique(flat, return_inverse=True)
    r = ratio[used] / 10
    starts = np.flatnonzero(np.diff(place, prepend=-1))  # every window has n-grams
    cost = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))
    w = np.full(len(used), 0.3)
    m, v = np.zeros(len(used)), np.zeros(len(used))
    for t in range(1, steps + 1):
        z = np.add.reduceat((w * r)[inner], starts) + PRIOR
        error = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(inner, weights=error[place], minlength=len(used)) * r + ridge * w / len(used)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.06 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = w * r
    return weights


def _worst(windows: _Windows, score: np.ndarray, n: int) -> np.ndarray:
    worst = np.full(n, -np.inf)
    np.maximum.at(worst, windows.owner, score)
    return worst


def _learn(windows: _Windows, label: np.ndarray, texts: np.ndarray, rounds: int = 3, steps: int = 60) -> np.ndarray:
    """Weights from the windows of ``texts`` (indices), choosing the bad windows of bad texts in rounds."""
    mine = np.isin(windows.owner, texts)
    bad = label[windows.owner] > 0
    short = ~np.isin(windows.owner, list(windows.long))
    others = windows.counts(np.flatnonzero(mine & ~bad))
    weights = _ratios(windows.counts(np.flatnonzero(mine & bad & short)) + windows.all_counts(texts), others) / 20
    for _ in range(rounds):
        windows.choose(weights, texts)
        score = windows.score(weights)
        worst = _worst(windows, score, len(label))[windows.owner]
        # of a bad text the windows near its worst count as bad; of the others the worst ones tell most
        near = np.where(worst > 0, score >= 0.7 * worst, score >= worst)
        picked = mine & ((bad & near) | (~bad & ((score >= worst - 0.5) | (windows.lot < 0.15))))
        ratio = _ratios(windows.counts(np.flatnonzero(mine & bad & near)), others)
        chosen = np.flatnonzero(picked)
        weights = _fit(*windows.take(chosen), bad[chosen].astype(float), ratio, steps)
    return weights


def _best_threshold(score: np.ndarray, label: np.ndarray, rate: float) -> float:
    """The threshold with the best F1 on held-out scores where a share ``rate`` of texts is bad, in the middle of its gap."""
    order = np.argsort(-score)
    bad = label[order] > 0
    hits, wrong = np.cumsum(bad), np.cumsum(~bad)
    weight = (1 - rate) / rate * bad.sum() / max((~bad).sum(), 1)
    f1 = 2 * hits / (hits + wrong * weight + bad.sum())
    k = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
    low = score[order[k + 1]] if k + 1 < len(score) else score[order[k]] - 1
    return float((score[order[k]] + low) / 2)


def train(texts: list[str | None], labels: list[bool], seed: int = 5) -> Model:
    """A model from labelled texts.  Without both kinds of labels nothing is ever a case."""
    kept: dict[str, list[bool]] = {}
    for t, bad in zip(texts, labels, strict=True):
        if c := comparable(t):
            kept.setdefault(c, []).append(bad)
    # judged twice: the majority; an even vote is no label
    voted = [(t, sum(v) * 2 > len(v)) for t, v in sorted(kept.items()) if sum(v) * 2 != len(v)]
    label = np.array([b for _, b in voted], int)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(1 << BITS), PRIOR, -PRIOR)
    rng = np.random.default_rng(seed)
    whole = [t for t, _ in voted]
    windows = _Windows(whole, label > 0, rng)
    fold = rng.permutation(len(label)) % FOLDS
    usable = np.ones(len(label), bool)
    held = np.zeros(len(label))
    for k in range(FOLDS):
        part = np.flatnonzero(fold != k)
        if 0 < label[part].sum() < len(part):
            model = Model(_learn(windows, label, part, rounds=1, steps=40), PRIOR, 0.0)
            # by the measure that texts are scored with: the worst of all windows
            out = np.flatnonzero(fold == k)
            held[out] = model.scores([whole[i] for i in out])
    # a firm contradiction by a model that did not see the text: the label is set aside
    if (label > 0).sum() >= 30:
        # where four in five bad texts are found unseen, those not found are taken for wrong labels
        firm = 0.0 if np.quantile(held[label > 0], 0.2) > 0.5 else -2.0
        usable = ~(((label > 0) & (held < firm)) | ((label == 0) & (held > 3)))
    weights = _learn(windows, label, np.flatnonzero(usable))
    held, label = held[usable], label[usable]
    return Model(weights, PRIOR, _best_threshold(held, label, (label.sum() + 0.5) / (len(label) + 1)), held, label)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: text, bad; out: the model, in one row."""
    texts: list[str] = []
    labels: list[bool] = []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    m = train(texts, labels)
    held, label = (None, None) if m.held is None else (m.held.astype("<f8").tobytes(), m.label.astype("u1").tobytes())
    yield pa.RecordBatch.from_pylist([{"weights": m.weights.astype("<f4").tobytes(), "bias": m.bias, "threshold": m.threshold, "held": held, "label": label}], schema=_MODEL)


_MODEL = pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("threshold", pa.float64()), ("held", pa.binary()), ("label", pa.binary())])


def fitted(documents: DataFrame, reviews: DataFrame) -> Model:
    """A model from the reviewed ``documents`` (doc_id, text) of ``reviews`` (doc_id, label).

    Of reviews at most SAMPLE_BAD bad and SAMPLE_GOOD good ones are taken, in the order of a hash
    of their ids.  Null labels and texts are left out.  One task fits the model; the driver gets
    its weights and one score per label.
    """
    judged = reviews.where(F.col("label").isNotNull()).select("doc_id", F.lower(F.trim("label")).isin(*BAD_LABELS).alias("bad"))
    chosen = [judged.where(F.col("bad") == bad).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for bad, most in ((True, SAMPLE_BAD), (False, SAMPLE_GOOD))]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # SAMPLE_BAD + SAMPLE_GOOD rows
    texts = documents.select("doc_id", "text").where("text is not null").join(ids, "doc_id").select("text", "bad")
    rows = texts.repartition(1).mapInArrow(_train, "weights binary, bias double, threshold double, held binary, label binary").collect()
    if not rows:
        return train([], [])
    r = rows[0]
    held, label = (None, None) if r.held is None else (np.frombuffer(r.held, "<f8"), np.frombuffer(r.label, "u1").astype(int))
    return Model(np.frombuffer(r.weights, "<f4"), r.bias, r.threshold, held, label)


def _score(model_in):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_in.value
        for batch in batches:
            texts = [comparable(t) for t in batch.column(2).to_pylist()]
            score = model.scores(texts)
            blank = np.array([not t for t in texts], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64(), mask=blank)], names=["rec_kind", "rec_id", "odds"])

    return run


def score_texts(texts: DataFrame, model: Model) -> DataFrame:
    """``rec_kind, rec_id, score`` of ``texts`` (rec_kind, rec_id, text), one row per row.

    A score of at least 0.5 marks a case.  The threshold follows the rate of bad texts among all
    of ``texts``, which are scored once.  Null, empty and blank texts score 0; an empty table
    gives no rows.  Whole texts are read, however long.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats
    rows = texts.select(F.col("rec_kind").cast("string"), F.col("rec_id").cast("bigint"), F.col("text").cast("string"))
    scored = stage(rows.mapInArrow(_score(sent), "rec_kind string, rec_id bigint, odds double"), "text-scores")
    seen = scored.agg(F.count("odds").alias("n"), F.count_if(F.col("odds") > COUNTED).alias("bad")).collect()[0]
    above = F.least(F.greatest(F.col("odds") - model.threshold_at(seen.bad, seen.n), F.lit(-30.0)), F.lit(30.0))
    return scored.select("rec_kind", "rec_id", F.when(F.col("odds").isNull(), 0.0).otherwise(1 / (1 + F.exp(-above))).alias("score"))
