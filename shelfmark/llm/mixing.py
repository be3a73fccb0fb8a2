"""Mixing sources to target weights: soft membership and a projected least-squares fit.

1. The corpus encoder counts the tokens of every text; from here texts are known by their digests.
   Equal texts are one unit: together they may be used ``max_repeats`` times, the least of their
   sources' limits.  A text found in several sources belongs to each in part.
2. A naive Bayes classifier, fitted in one task on texts with a source, gives texts without one a
   posterior over the sources.  Texts found only in sources without a target take no part.
3. Projected gradient steps fit a rate between 0 and its limit to every text, so that the expected
   tokens of each source meet their targets.  A step needs one number per source, so the driver
   holds a vector of that length and the texts stay where they are.
4. Rates become whole copies: the integer part, and one more for texts whose hashed lot falls under
   a line; the line of each source is set where the source's tokens come nearest to the target.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .bpe import TOKENIZERS, count_tokens
from .sources import source_name

#: Most texts with a source that the classifier is fitted on, and the buckets of its hashed words.
SAMPLE, BUCKETS = 8000, 1 << 16
#: Most steps of the fit, the largest miss of a share at which it has settled, and steps after which rates are written.
STEPS, MISS, WRITTEN = 100, 1e-4, 8

_WORD = re.compile(r"\w+|[^\w\s]|\n")


class SourceClassifier:
    """Multinomial naive Bayes on hashed words, with tempered evidence so that long texts are not overconfident."""

    @classmethod
    def of(cls, prior: bytes, weights: bytes) -> SourceClassifier:
        model = cls.__new__(cls)
        model.prior = np.frombuffer(prior, "<f8")
        model.weights = np.frombuffer(weights, "<f4").reshape(len(model.prior), BUCKETS)
        return model

    def __init__(self, texts: list[str], labels: list[int], k: int) -> None:
        counts = np.full((k, BUCKETS), 0.1)
        for t, label in zip(texts, labels, strict=True):
            for b, n in self._bag(t).items():
                counts[label, b] += math.log1p(n)
        seen = np.bincount(labels, minlength=k)
        self.prior = np.where(seen > 0, np.log(np.maximum(seen, 1) / max(len(labels), 1)), -np.inf)
        self.weights = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    @staticmethod
    def _bag(text: str) -> Counter[int]:
        import zlib

        return Counter(zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS for w in _WORD.findall(text))

    def posterior(self, text: str) -> np.ndarray:
        bag = self._bag(text)
        z = self.prior.copy()
        if bag:
            logs = np.log1p(np.array(list(bag.values())))
            z = z + (self.weights[:, list(bag)] @ logs) / max(1.0, logs.sum() / 10)
        p = np.exp(z - z.max())
        return p / p.sum()


def _fit(k: int):
    """Columns in: text, place (from 1); out: the classifier's prior and weights, in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        places: list[int] = []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            places += [p - 1 for p in batch.column(1).to_pylist()]
        if texts:
            m = SourceClassifier(texts, places, k)
            yield pa.RecordBatch.from_arrays([pa.array([m.prior.astype("<f8").tobytes()]), pa.array([m.weights.astype("<f4").tobytes()])], names=["prior", "weights"])

    return run


def _posteriors(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            pi = [model.posterior(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pi, pa.list_(pa.float64()))], names=["key", "posterior"])

    return run


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


class Mixture:
    """``texts``: one row per usable text with its copies; ``report``: one row per target source."""

    def __init__(self, texts: DataFrame, report: DataFrame) -> None:
        self.texts, self.report = texts, report


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, folder: str = TOKENIZERS) -> Mixture:
    """Fit copies of the texts of ``documents`` (doc_id, text, source) to ``targets`` (source, weight, max_repeats).

    Without ``total_tokens`` the mixture is as large as the limits allow.  Names are compared
    after ``source_name``.  Targets of one name are added up, with the least limit; null or
    negative weights and limits count as 0.  A source without texts gets nothing and the others
    share its weight.  Null and empty texts have no tokens and no copies.  With no usable text
    the report has zeros and ``texts`` no rows.  ``settled`` tells whether the fitted rates met
    all targets within MISS of the whole before STEPS were taken.
    """
    spark = documents.sparkSession
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    goal = wanted.where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats")).orderBy("source").collect()
    names, k = [r.source for r in goal], len(goal)
    weight, limit = np.array([r.weight for r in goal]), np.array([r.max_repeats for r in goal])

    rows = documents.where(F.length("text") > 0).select("doc_id", "text", F.sha2("text", 256).alias("key"), source_name(F.col("source")).alias("source"))
    place = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("source")).cast("int")
    unit = rows.select(F.struct("doc_id", "key", "source", place.alias("place")).alias("unit"), "text")
    counted = stage(count_tokens(unit, "unit", "text", folder=folder).select("unit.*", "n_tokens"), "mix-tokens")
    known = [F.sum((F.col("place") == j + 1).cast("double")).alias(f"n{j}") for j in range(k)]
    strange = F.col("source").isNotNull() & (F.coalesce("place", F.lit(0)) == 0)
    units = counted.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.count_if(~strange).alias("usable"), *known)
    counts = F.array(*[F.coalesce(f"n{j}", F.lit(0.0)) for j in range(k)]).cast("array<double>")
    units = units.where("usable > 0").select("key", "doc_id", "n_tokens", counts.alias("counts"))
    units = units.withColumn("labelled", F.aggregate("counts", F.lit(0.0), lambda s, x: s + x))

    own = units.where((F.array_max("counts") == F.col("labelled")) & (F.col("labelled") > 0)).orderBy("key").limit(SAMPLE)
    own = own.select("doc_id", "key", F.expr("array_position(counts, array_max(counts))").cast("int").alias("place"))
    sample = rows.select("doc_id", "key", "text").join(F.broadcast(own), ["doc_id", "key"]).dropDuplicates(["key"])  # SAMPLE rows
    fitted = sample.select("text", "place").repartition(1).mapInArrow(_fit(k), "prior binary, weights binary").collect() if k else []
    unlabelled = rows.where("source is null").select("key", "text")
    if fitted:
        model = spark.sparkContext.broadcast(SourceClassifier.of(*fitted[0]))  # BUCKETS numbers a source
        guessed = unlabelled.mapInArrow(_posteriors(model), "key string, posterior array<double>").groupBy("key").agg(F.first("posterior").alias("posterior"))
    else:
        guessed = unlabelled.select("key", F.lit(None).cast("array<double>").alias("posterior")).where("false")
    pi = F.when(F.col("labelled") > 0, F.transform("counts", lambda x: x / F.col("labelled"))).otherwise(F.col("posterior"))
    cap = F.array_min(F.filter(F.zip_with("pi", _doubles(limit), lambda p, c: F.when(p >= 0.05, c)), lambda c: c.isNotNull()))
    members = units.join(guessed, "key", "left").select("key", "doc_id", "labelled", F.col("n_tokens").cast("double").alias("n"), pi.alias("pi"))
    members = stage(members.where("pi is not null and n > 0").withColumn("cap", F.coalesce(cap, F.lit(0.0))).withColumn("place", F.expr("array_position(pi, array_max(pi))").cast("int")), "mix-members")

    def by_source(value: Column) -> list[Column]:
        return [F.coalesce(F.sum(value * F.col("n") * F.col("pi")[j]), F.lit(0.0)).alias(f"s{j}") for j in range(k)]

    def vector(df: DataFrame, value: Column) -> np.ndarray:
        return np.array(list(df.agg(*by_source(value)).collect()[0]), float) if k else np.zeros(0)

    size, room = vector(members, F.lit(1.0)), vector(members, F.col("cap"))
    share = np.where(room > 0, weight, 0)
    share = share / share.sum() if share.sum() else share
    asked = share > 0
    total = total_tokens if total_tokens is not None else float(np.min(room[asked] / share[asked])) if asked.any() else 0.0
    target = np.minimum(share * total, room)

    start = np.divide(target, room, out=np.zeros(k), where=room > 0)
    first = F.least(F.col("cap"), F.col("cap") * F.aggregate(F.zip_with("pi", _doubles(start), lambda p, s: p * s), F.lit(0.0), lambda a, x: a + x)) if k else F.lit(0.0)
    steps: list[np.ndarray] = []
    fit, rate, settled = members, first, not asked.any() or total <= 0
    for _ in range(STEPS if not settled else 0):
        state = fit.withColumn("rate", rate)
        sums = [by_source(F.col("rate")), by_source((F.col("rate") < F.col("cap")).cast("double")), by_source((F.col("rate") > 0).cast("double"))]
        row = list(state.agg(*[c.alias(f"{part}{j}") for part, columns in enumerate(sums) for j, c in enumerate(columns)]).collect()[0])
        reached, rising, falling = (np.array(row[part * k : part * k + k], float) for part in range(3))
        if np.abs(reached - target).max() / total < MISS:
            settled = True
            break
        if len(steps) == WRITTEN:  # the expression of the rate stays short
            fit = stage(state, "mix-steps")
            first, steps = F.col("rate"), []
        # each source's step is scaled by the tokens whose rates can still move its way
        free = np.where(reached < target, rising, falling)
        steps.append(np.divide(reached - target, free, out=np.zeros(k), where=free > 0))
        moves = F.array(*[_doubles(s) for s in steps])
        rate = F.aggregate(moves, first, lambda r, g: F.greatest(F.lit(0.0), F.least(F.col("cap"), r - F.aggregate(F.zip_with(F.col("pi"), g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x))))
    members = fit
    lot = (F.pmod(F.xxhash64(F.lit("lot"), "key"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    fitted = stage(members.withColumn("rate", rate).withColumn("lot", lot), "mix-rates")

    def copies(line: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col("cap"), F.floor(F.col("rate") + line - F.col("lot") + 1)))

    # The line of each source: a search by 32 cuts at a time, for all sources in one pass.
    low, high = np.full(k, -1.0), np.full(k, 1.0)
    for _ in range(4 if asked.any() else 0):
        lines = [low + (high - low) * j / 31 for j in range(32)]
        own = F.col("n") * F.element_at("pi", F.col("place"))
        sums = fitted.groupBy("place").agg(*[F.sum(own * copies(F.element_at(_doubles(line), F.col("place")))).alias(f"c{j}") for j, line in enumerate(lines)], F.sum(F.col("rate") * own).alias("fit")).collect()
        for r in sums:
            d = r.place - 1
            # what other sources' texts give to this one in part is left as fitted
            aim = r.fit if share[d] > 0 else 0.0
            got = np.array([r[f"c{j}"] for j in range(32)])
            at = int(np.searchsorted(got, aim))
            low[d], high[d] = lines[max(at - 1, 0)][d], lines[min(at, 31)][d]
    line = (low + high) / 2
    final = copies(F.element_at(_doubles(line), F.col("place"))) if k else F.lit(0.0)
    used = stage(fitted.withColumn("copies", final), "mix-copies")

    reached, uses = vector(used, F.col("copies")), vector(used.withColumn("n", F.lit(1.0)), (F.col("copies") > 0).cast("double"))
    units_of = vector(used.withColumn("n", F.lit(1.0)), F.lit(1.0))
    most = {r.place - 1: r.most for r in used.groupBy("place").agg(F.max("copies").alias("most")).collect()}
    all_tokens = reached.sum()
    schema = "source string, weight double, target_share double, share double, tokens double, available_tokens double, texts double, texts_used double, most_copies int, max_repeats int, settled boolean"
    report = [(names[j], float(weight[j]), float(share[j]), float(reached[j] / all_tokens) if all_tokens else 0.0, float(reached[j]), float(size[j]), float(units_of[j]), float(uses[j]), int(most.get(j, 0)), int(limit[j]), bool(settled)) for j in range(k)]
    named = F.element_at(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("place")) if k else F.lit(None).cast("string")
    chosen = used.where("copies > 0").select("doc_id", named.alias("source"), (F.col("labelled") > 0).alias("source_is_stated"), F.col("n").cast("bigint").alias("n_tokens"), F.col("copies").cast("int").alias("copies"))
    return Mixture(chosen, spark.createDataFrame(report, schema))
