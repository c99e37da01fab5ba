import math

import numpy as np
from pyspark.sql import functions as F

from tallyrift.llm.topk import far_apart, search, top_k


def brute(rows, k, scale=64):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(good):
        if q is not None and q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(good) if m != n)
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return out


def run(spark, rows, k):
    v = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, row int, score double")
    return [tuple(r) for r in top_k(v, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect()]


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(8) * r.choice([0.1, 1, 30])).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]  # a hot group of copies: ties
    rows += [(2001, None), (2002, [None] * 8), (2003, [math.nan] * 8), (2004, [math.inf] * 8), (2020, [0.0] * 8)]
    assert run(spark, rows, 20) == sorted(brute(rows, 20))


def test_few_rows(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0]), (20, [-1.0])], 5) == [(0, 1, 1, 64 * 128), (0, 2, 20, -64 * 64), (20, 1, 0, -64 * 64), (20, 2, 1, -64 * 128)]
    assert run(spark, [(0, [1.0])], 5) == []
    assert run(spark, [], 5) == []
    twice = [(20, [1.0]), (20, [2.0]), (None, [3.0]), (2**53 + 1, [1.0]), (2**53, [1.0])]  # rows that repeat an id, a null id, ids beyond doubles
    got = run(spark, twice, 9)
    assert [(r[2], r[3]) for r in got if r[3] == 64 * 64] == [(2**53, 4096), (2**53 + 1, 4096)] and len(got) == 8


def test_bounds_leave_half_out_where_rows_are_clustered():
    r = np.random.default_rng(2)
    middle = r.standard_normal((60, 16)) * 40
    x = np.floor(middle[r.integers(0, 60, 6000)] + r.standard_normal((6000, 16)))
    q, top = x[:50], float((x**2).sum(1).max())
    piv = far_apart(x[:1024], 64)
    up, p_up = np.sqrt(top - (x**2).sum(1)), np.sqrt(top - (piv**2).sum(1))
    far = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(2)
    dq, dx = np.sqrt(far(q, piv) + p_up**2), np.sqrt(far(x, piv) + (up[:, None] - p_up) ** 2)
    i, j, score, evaluated = search(q, x, np.arange(50), np.arange(6000), dq, dx, top, 20, np.full(50, -np.inf))
    assert evaluated < 0.55 * len(q) * len(x)
    for n in range(50):
        full = x @ q[n]
        full[n] = -np.inf
        assert score[i == n].tolist() == full[np.lexsort((np.arange(6000), -full))[:20]].tolist()
        assert j[i == n].tolist() == np.lexsort((np.arange(6000), -full))[:20].tolist()
