import random

import numpy as np
import pytest

from tallyrift.operators import quantiles as q
from tallyrift.operators import reports

SCHEMA = "key string, v double, n int"


def made(spark, rows):
    return spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)


@pytest.mark.parametrize("kind", ["distinct", "equal", "few"])
def test_against_numpy(spark, kind):
    r = random.Random(1)
    draw = {"distinct": lambda i: i * 0.37 + r.random() / 9, "equal": lambda i: 5.0 if r.random() < 0.7 else r.random() * 9, "few": lambda i: float(r.randint(-3, 3))}[kind]
    rows = [(r.choice(["a", "a", "a", "b", None]), draw(i)) for i in range(4000)] + [("one", 2.5), ("none", None), ("a", float("nan")), ("two", 1.0), ("two", 2.0)]
    shares = {"least": 0.0, "q1": 0.25, "x": 0.333, "q2": 0.5, "q3": 0.75, "largest": 1.0}
    found = {x.key: x for x in q.quantiles(made(spark, rows), ["key"], "v", shares).collect()}
    assert set(found) == {"a", "b", None, "one", "two"}
    for k, row in found.items():
        own = [v for key, v in rows if key == k and v is not None and v == v]
        assert row.n == len(own)
        for name, share in shares.items():
            assert row[name] == pytest.approx(np.quantile(own, share), abs=1e-9)


def test_without_keys_or_rows(spark):
    rows = made(spark, [("a", float(i)) for i in range(10)])
    assert [tuple(r) for r in q.quantiles(rows, [], "v", {"m": 0.5}).collect()] == [(10, 4.5)]
    assert q.quantiles(rows.limit(0), ["key"], "v", {"m": 0.5}).collect() == []
    assert tuple(reports.center(rows.limit(0), "v").first()) == (None, None) and tuple(reports.center(rows, "v").first()) == (4.5, 4.5)


def test_ranges_hold_part_of_the_values(spark):
    rows = spark.range(20000).selectExpr("'a' as key", "cast(id * 7 % 20011 as double) as v", "1 as n")
    stashed = []
    keep, q.stash = q.stash, lambda df, name: stashed.append(keep(df, name)) or stashed[-1]
    try:
        found = q.quantiles(rows, ["key"], "v", {"m": 0.5}).first()
    finally:
        q.stash = keep
    assert found.m == pytest.approx(np.median([i * 7 % 20011 for i in range(20000)]))
    sizes = [r["count"] for r in stashed[0].groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10000


def test_box_plot(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 40, -30]] + [("b", 1.0), ("c", None)]
    box = {r.key: r for r in q.box_plot(made(spark, rows), "key", "v").collect()}
    assert (box["a"].whisker_low, box["a"].whisker_high, box["a"].outliers, box["a"].least, box["a"].largest) == (1.0, 9.0, 2, -30.0, 40.0)
    assert (box["b"].q1, box["b"].whisker_low, box["b"].outliers) == (1.0, 1.0, 0) and "c" not in box
    assert sorted(r.v for r in q.outliers(made(spark, rows), "key", "v").collect()) == [-30.0, 40.0]
