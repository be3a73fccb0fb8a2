import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.neighbours import Plan, bucket_codes, choose_plan, hadamard, hash_axes, near_pairs, nearest, pseudo_rotate, sketch, unsketch, usable_vectors

D = 64
T0 = dt.datetime(2024, 1, 1)


def _table(spark, vectors, extra=()):
    rows = [(k, 1, [float(x) for x in v], T0, "x") for k, v in vectors.items()] + list(extra)
    return spark.createDataFrame(rows, "image_id bigint, model_id bigint, vector array<float>, updated_at timestamp, key string")


def _clusters(n, seed=0, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, D))
    return {k: centres[k % len(centres)] + spread * rng.standard_normal(D) * np.sqrt(D) / 4 for k in range(n)}


def _brute(vectors, k, most=None):
    ids = sorted(vectors)
    m = np.array([np.asarray(vectors[i], "f4").astype(float) for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for a, i in enumerate(ids):
        d = np.round(1 - m @ m[a], 7)
        d[a] = 9
        best = np.argsort(d, kind="stable")[:k]
        out[i] = [ids[b] for b in best if most is None or d[b] <= most]
    return out


def test_rotation_keeps_angles():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, D)).astype("f4")
    y = pseudo_rotate(x, rng.choice([-1.0, 1.0], (3, D)).astype("f4"))
    assert np.allclose(x @ x.T, y @ y.T / 64**3, atol=1e-2)
    assert np.allclose(hadamard(hadamard(x)) / D, x, atol=1e-4)
    codes = bucket_codes(x, 2, (64, 64), 3)
    assert codes.shape == (20, 4) and all(len(set(r)) == 4 for r in codes)
    assert np.abs(unsketch(sketch(x)) - x).max() < np.abs(x).max() / 200


def test_only_the_newest_usable_row_counts(spark):
    one = [1.0] + [0.0] * (D - 1)
    bad = [(2, 1, None, T0, ""), (3, 1, one[:5], T0, ""), (4, 1, [0.0] * D, T0, ""), (5, 1, [float("nan")] * D, T0, ""), (6, 2, one, T0, ""), (None, 1, one, T0, ""), (8, 1, [float("inf")] * D, T0, ""), (9, 1, [None] + one[1:], T0, "")]
    newer = [(7, 1, one, T0, ""), (7, 1, [0.0] * D, T0 + dt.timedelta(days=1), ""), (1, 1, one, T0 - dt.timedelta(days=1), ""), (1, 1, one, T0, "")]
    got = usable_vectors(_table(spark, {1: one}, bad + newer), 1, D).collect()
    assert [r.id for r in got] == [1]


def test_near_pairs_are_found(spark):
    v = _clusters(400)
    table = usable_vectors(_table(spark, v), 1, D)
    for block in (8192, 8):  # also with every bucket split
        got = {tuple(r) for r in near_pairs(nearest(table, D, 5, 0.1, plan=Plan((64, 64), 3, 2), block=block)).collect()}
        want = {(min(a, b), max(a, b)) for a, near in _brute(v, 5, 0.1).items() for b in near}
        assert len(want) > 300 and len(got & want) >= 0.97 * len(want)
        assert len(got - want) <= 0.03 * len(want)


def test_recall_of_any_distance(spark):
    rng = np.random.default_rng(5)
    v = {k: rng.standard_normal(D) for k in range(2000)}
    got = {}
    for r in nearest(usable_vectors(_table(spark, v), 1, D), D, 5, queries=F.col("id") % 100 == 0, plan=Plan((64,), 2, 40)).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = _brute(v, 5)
    asked = [k for k in v if k % 100 == 0]
    assert sum(len(got[k] & set(want[k])) for k in asked) / (5 * len(asked)) >= 0.9


def test_plans_grow_slower_than_the_table():
    compared = []
    for n in (5_000, 20_000, 80_000, 10**7):
        p = choose_plan(n, n, D, 0.1, 0.8)
        compared.append(p.tables * (p.probes + 1) * n / np.prod([2 * a for a in p.axes]))
    assert compared[2] < compared[0] * 16**0.5 and compared[3] < compared[0] * 2000**0.5
    assert choose_plan(10, 10, D, 0.1, 0.9) == Plan((), 1, 0)  # few rows are one bucket
    assert [hash_axes(b, D) for b in (0, 1, 7, 8, 14, 15)] == [(), (1,), (64,), (64, 1), (64, 64), (64, 64, 1)]


@pytest.mark.parametrize("n", [3000, 12000])
def test_a_plan_keeps_its_promise(n):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((n, D))
    b = a / np.linalg.norm(a, axis=1, keepdims=True) + 0.485 * (x := rng.standard_normal((n, D))) / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = (y / np.linalg.norm(y, axis=1, keepdims=True) for y in (a, b))
    p = choose_plan(n, n, D, 0.1, 0.9)
    found = np.zeros(n, bool)
    for t in range(p.tables):
        found |= (bucket_codes(a.astype("f4"), t, p.axes, p.probes) == bucket_codes(b.astype("f4"), t, p.axes, 0)).any(axis=1)
    assert np.median(1 - (a * b).sum(axis=1)) == pytest.approx(0.1, abs=0.01) and found.mean() > 0.86


def test_planned_recall(spark):
    v = _clusters(4000, 1, 0.08)
    got = {tuple(r) for r in near_pairs(nearest(usable_vectors(_table(spark, v), 1, D), D, 5, 0.1, recall=0.8)).collect()}
    want = {(min(a, b), max(a, b)) for a, near in _brute(v, 5, 0.1).items() for b in near}
    assert len(want) > 3000 and len(got & want) >= 0.97 * len(want)


def test_copies_of_a_hot_vector(spark):
    v = _clusters(60, 3)
    hot = np.ones(D)
    v |= {1000 + k: hot for k in range(300)}
    got = {}
    for r in nearest(usable_vectors(_table(spark, v), 1, D), D, 3, 0.1).collect():
        got.setdefault(r.id, []).append((r.distance, r.other))
    for k in range(300):
        others = [1000 + j for j in range(300) if j != k][:3]
        assert sorted(o for _, o in got[1000 + k]) == others
        assert max(d for d, _ in got[1000 + k]) == pytest.approx(0, abs=1e-9)


def test_nearly_equal_vectors(spark):
    rng = np.random.default_rng(8)
    v = _clusters(80, 3)
    centre = rng.standard_normal(D)
    v |= {1000 + k: centre + 0.03 * rng.standard_normal(D) for k in range(300)}  # closer than 8-bit copies tell
    table = usable_vectors(_table(spark, v), 1, D)
    want = {(a, b) for a, near in _brute(v, 5, 0.1).items() for b in near}
    for block in (8192, 64):
        got = {(r.id, r.other) for r in nearest(table, D, 5, 0.1, plan=Plan((64, 64), 3, 2), block=block).collect()}
        hot = {x for x in want if x[0] >= 1000}
        assert len(hot) == 1500 and len(got & hot) >= 0.999 * len(hot)


def test_empty(spark):
    assert nearest(usable_vectors(_table(spark, {}), 1, D), D).collect() == []
