"""Column expressions on float vectors; they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared norms below this count as no direction.
TINY = 1e-12
#: Weights of liked and skipped items, and how far feedback may move a query.
LIKED, SKIPPED, DRIFT = 0.35, 0.15, 0.35


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; inside a lambda it would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_norm(v: Column) -> Column:
    return _sum(F.transform(doubles(v), lambda x: x * x))


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """Cosine of two vectors in double precision; 0 if either has no length.

    Null vectors, empty ones and such of unequal lengths give null, or an error with ``strict``.
    """
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    na, nb = squared_norm(a), squared_norm(b)
    value = F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))
    wrong = F.raise_error(F.lit("vector dimensions differ")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(fits, value).otherwise(wrong)


def cosine_distance(a: Column, b: Column, strict: bool = False) -> Column:
    return 1 - cosine(a, b, strict)


def normalized(v: Column) -> Column:
    """The unit vector as float32; null for empty vectors and such without a direction."""
    n2 = squared_norm(v)
    unit = _let((1 / F.sqrt(n2)).cast("float"), lambda inverse: F.transform(v.cast("array<float>"), lambda x: (x * inverse).cast("float")))
    return F.when((F.size(v) > 0) & (n2 >= TINY), unit)


def native_normalized(v: Column) -> Column:
    """The unit vector; a vector whose squares sum to 0 stays as it is."""
    n2 = squared_norm(v)
    unit = _let(F.sqrt(n2), lambda length: F.transform(doubles(v), lambda x: (x / length).cast("float")))
    return F.when(n2 > 0, unit).otherwise(v.cast("array<float>"))


def without(query: Column, negative: Column) -> Column:
    """Query minus negative, renormalized; the plain query if nothing is left or lengths differ with null negative."""
    difference = F.zip_with(doubles(query), doubles(negative), lambda x, y: (x - y).cast("float"))
    n2 = squared_norm(difference)
    moved = _let((1 / F.sqrt(n2)).cast("float"), lambda inverse: F.transform(difference, lambda x: (x * inverse).cast("float")))
    wrong = F.raise_error(F.lit("query and negative query differ in length")).cast("array<float>")
    return F.when(negative.isNull(), query.cast("array<float>")).when(F.size(query) != F.size(negative), wrong).when(n2 < TINY, query.cast("array<float>")).otherwise(moved)


def feedback_query(seed: Column, liked: Column, skipped: Column) -> Column:
    """The seed's direction moved by the means of liked and skipped unit vectors, by at most DRIFT.

    ``liked`` and ``skipped`` are mean vectors or null; with neither, and where the seed has no
    direction or the sum none, the plain seed is returned.
    """
    zero = F.transform(doubles(seed), lambda x: F.lit(0.0))
    part = lambda mean, weight: F.coalesce(F.transform(doubles(mean), lambda x: x * weight), zero)
    delta = F.zip_with(part(liked, LIKED), part(skipped, -SKIPPED), lambda x, y: x + y)
    scale = lambda length: F.when(length > DRIFT, DRIFT / length).otherwise(1.0)
    held = _let(delta, lambda d: _let(scale(F.sqrt(squared_norm(d))), lambda s: F.transform(d, lambda x: x * s)))
    moved = _let(F.zip_with(doubles(normalized(seed)), held, lambda x, d: (x + d).cast("float")), normalized)
    return F.when(liked.isNull() & skipped.isNull(), seed.cast("array<float>")).otherwise(F.coalesce(moved, seed.cast("array<float>")))


def mean_vector(rows, key: list[str], vector: str, dim: int | None = None):
    """DataFrame: the mean of the normalized vectors per key; wrong lengths and vectors without a direction are passed over.

    With ``dim`` the places are ``dim`` averages of one aggregation, summed where the rows lie.
    """
    unit = rows.select(*key, normalized(F.col(vector)).alias("unit"))
    if dim is not None:
        sums = unit.where(F.size("unit") == dim).groupBy(*key).agg(*[F.avg(F.col("unit")[k].cast("double")).alias(f"m{k}") for k in range(dim)])
        return sums.select(*key, F.array(*[F.col(f"m{k}") for k in range(dim)]).alias("mean"))
    unit = unit.where(F.col("unit").isNotNull())
    places = unit.select(*key, F.posexplode("unit").alias("pos", "x"))
    means = places.groupBy(*key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def match_score(distance: Column, source: Column) -> Column:
    """1 - distance, held between 0 and 1; null for tag results."""
    return F.when(F.coalesce(source, F.lit("")) == "tag", F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)))
