"""Top k against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlake.llm import pivot_search as P


def whole(n):
    """What is beyond a 64-bit integer takes its end."""
    return max(-(2**63), min(2**63 - 1, n))


def brute(rows, asked, k):
    def ints(v):
        return None if not v or any(x is None or not math.isfinite(x) for x in v) else [whole(math.floor(64 * x) if abs(x) < 1e300 else int(x)) for x in v]

    known = [(i, ints(v)) for i, v in rows if i is not None and ints(v)]
    out = []
    for i, q in {(i, tuple(ints(v))) for i, v in asked if i is not None and ints(v)}:
        scores = sorted((-whole(sum(a * b for a, b in zip(q, v))), j) for j, v in known if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def vectors(seed, n, dims, scale=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [scale * (c + rnd.gauss(0, 0.3)) for c in rnd.choice(centres)]) for i in range(n)]
    rows += [(n + i, list(rows[3][1])) for i in range(n // 3)]  # one common vector
    rows += [(-1, None), (-2, []), (-3, [1.0, None]), (-4, [float("nan")] * dims), (-5, [float("inf")] * dims), (None, [1.0] * dims), (40, list(rows[7][1])), (60, rows[60][1]), (-20, [0.5])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("dims,scale,block", [(8, 1.0, 4096), (3, 900.0, 7), (2, 5e5, 4096), (2, 2e7, 4096), (3, 1e17, 50), (2, 1e305, 4096)])
def test_top_k_equals_brute_force(spark, dims, scale, block):
    rows = vectors(dims, 150, dims, scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("v", F.lit(1))
    asked = df.where("vec_id % 20 = 0")
    got = sorted(tuple(r) for r in P.top_k(spark, df, asked, 20, query_block=block).collect())
    want = brute(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 20)
    assert got == want


def test_few_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (21, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in P.top_k(spark, df, df.where("vec_id = 20"), 20).collect()] == [(20, 1, 21, 64 * 64)]
    assert P.top_k(spark, df.limit(0), df.limit(0), 20).count() == 0
    assert P.top_k(spark, df.limit(0), df, 20).count() == 0


def test_bounds_eliminate_and_stop():
    """On tight clusters most rows are never evaluated."""
    rng = np.random.default_rng(1)
    v = (rng.normal(0, 300, (40, 6))[rng.integers(0, 40, 4000)] + rng.normal(0, 3, (4000, 6))).astype(np.int32)
    norms = (v.astype(np.int64) ** 2).sum(1)
    top = int(norms.max())
    full = P._filled(v, norms, top)
    pivots = P.farthest_first(full, 32)
    asked = np.arange(0, 4000, 400)
    search = P.Search(asked, v[asked], pivots, top, 5, np.full(len(asked), -(1 << 62)))
    search.offer(np.arange(4000), v, P._distances(full, pivots).astype(np.float32))
    for n, q in enumerate(asked):
        scores = v.astype(np.int64) @ v[q].astype(np.int64)
        assert search.best[n] == sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
    assert search.evaluated < 0.6 * search.offered
