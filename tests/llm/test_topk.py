import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from neighborflow.llm import topk as T


def truth(rows, k=5, divisor=50):
    sound = lambda v: v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)
    held = [(i, n, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and sound(v)]
    out = []
    for q, n, a in held:
        if q % divisor == 0:
            long = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            scores = sorted((-long(sum(x * y for x, y in zip(a, b))), i) for i, m, b in held if m != n)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in T.top_k(spark, df, k).collect())


@pytest.mark.parametrize("blocks", [(7, 3), (1024, 256)])
def test_against_all_pairs(spark, blocks, monkeypatch):
    """Clusters, ties, repeats, negative ids and vectors of several lengths, in many small blocks and in one."""
    monkeypatch.setattr(T, "BLOCK", blocks[0])
    monkeypatch.setattr(T, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 9))
    rows = [(int(i) - 100, (centres[i % 6] + 0.05 * rng.normal(size=9)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)] + [(50, rows[7][1]), (50, rows[7][1]), (2000, [0.0] * 9), (2050, []), (2051, [1.0, 2.0]), (2100, [3.0] * 4)]
    assert found(spark, rows) == truth(rows)


def test_unsound_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1e308, 1.0]), (None, [9.0, 9.0]), (50, [0.5, 0.25]), (6, [-0.001, 0.001])]
    assert found(spark, rows) == truth(rows)
    assert found(spark, rows[1:3]) == [] and found(spark, rows[:1]) == [] and found(spark, [(0, [1.0]), (7, [2.0])]) == [(0, 1, 7, 256 * 512)]


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [3e12, 1.0, 7.0])] + [(i, [2e12 + i / 256, float(i % 3), -float(i)]) for i in range(1, 40)] + [(50, [1e300, -1e300, 0.0])]
    assert found(spark, rows) == truth(rows)


def test_bounds_hold_and_rule_candidates_out(spark):
    """Clustered vectors: most pairs are never evaluated, and no score passes its bound."""
    rng = np.random.default_rng(2)
    v = np.floor(256 * np.repeat(10 * rng.normal(size=(20, 8)), 50, axis=0) + rng.normal(size=(1000, 8)))
    pivots = T.choose_pivots(v[::3], 16)
    d = T._distances(v, pivots)
    make = lambda at: T._Block(np.asarray(at, "<i8").tobytes(), np.asarray(at, "<i8").tobytes(), v[at].astype("<f4").tobytes(), d[at].astype("<f4").tobytes(), len(at), 8)
    q, c = make(np.arange(0, 1000, 20)), make(np.arange(1000))
    got, kth, pairs = T.search(q, c, np.full(50, -np.inf), 5, float(d.max()) ** 2)
    want = v[q.ids] @ v.T
    want[np.arange(50), q.ids] = -np.inf
    assert (kth == np.sort(want, axis=1)[:, -5]).all() and len(got) == 250
    assert pairs < 0.7 * 50 * 1000


def test_clashing_columns(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("id", "v", "row", "home", "far", "block", "score", "rank", "query_id"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted(tuple(r) for r in T.top_k(spark, df).collect()) == truth(rows)
