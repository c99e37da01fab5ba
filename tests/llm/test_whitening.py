import math

import numpy as np
import pytest

from tallyrift.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, deviation int"


def rows(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA)


def check(found, ids, x, k):
    """Against the covariance's own eigenvectors, by numpy."""
    n, d = x.shape
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-9).sum()))
    white = c @ vectors[:, :k] / np.sqrt(values[:k])
    whole = x.astype(int).astype(object)
    deviation = ((n * whole - whole.sum(0)) ** 2).sum(1)
    assert len(found) == n * k
    got = {(r.vec_id, r.component): r for r in found}
    sign = [np.sign(got[ids[0], j + 1].whitened) * np.sign(white[0, j]) for j in range(k)]
    for row, i in enumerate(ids):
        for j in range(k):
            r = got[i, j + 1]
            assert r.n == n and r.deviation == deviation[row] and r.identity_error <= 1e-9
            assert r.whitened == pytest.approx(sign[j] * white[row, j], abs=1e-6) and r.explained == pytest.approx(values[j] / values.sum(), rel=1e-9)


def integers(vectors):
    return np.floor(64 * np.array(vectors, np.float32).astype(float)) + 1_000_000


@pytest.mark.parametrize("block", [3, 4096])
def test_random(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    r = np.random.default_rng(1)
    vectors = (r.normal(size=(60, 6)) * [9, 5, 3, 2, 1, 0.5] + 4).astype(np.float32).tolist()
    vectors += [vectors[0], vectors[0]]
    frame = rows(spark, vectors).repartition(7)
    check(whitening.whitened(frame, 4).collect(), list(range(62)), integers(vectors), 4)


def test_odd_rows(spark):
    good = [[1.0, 2.0, 0.5], [0.0, -1.0, 3.0], [2.0, 2.0, 2.0], [1.5, -2.0, 1.0], [1.0, 2.0, 0.5]]
    bad = [None, [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 0.0, 0.0]]
    short = [[5.0], []]
    ids = [None, 1, 2, 3, 3]
    found = whitening.whitened(rows(spark, good + bad + short, [*ids, *range(10, 16)]), 32).collect()
    assert {r.vec_id for r in found} == {None, 1, 2, 3, 14, 15} and len(found) == 7 * 3
    padded = integers([*good, [5.0, 0, 0], [0.0, 0, 0]])
    one = sorted(r.deviation for r in found if r.component == 1)
    whole = padded.astype(int).astype(object)
    assert one == sorted(((7 * whole - whole.sum(0)) ** 2).sum(1))


def test_without_variance(spark):
    assert whitening.whitened(rows(spark, [])).collect() == []
    assert whitening.whitened(rows(spark, [None, [math.nan]])).collect() == []
    assert whitening.whitened(rows(spark, [[1.0, 2.0]] * 3)).collect() == []
    few = whitening.whitened(rows(spark, [[1.0, 2.0, 7.0], [2.0, 2.0, 7.0]])).collect()  # one component has variance
    assert len(few) == 2 and {abs(round(r.whitened, 9)) for r in few} == {1.0}


def test_names_with_dots(spark):
    named = rows(spark, [[1.0, 2.0], [2.0, 1.0]]).withColumnRenamed("x", "a.b")
    assert {r["a.b"] for r in whitening.whitened(named, 1, keep=("vec_id", "a.b")).collect()} == {"x"}


def test_deviations_beyond_long():
    x = np.array([[2**40, 0], [0, 0]], np.int64)
    assert whitening.deviations(x, 2, [2**40, 0]) == [None, None]
    assert whitening.deviations(np.array([[3, 1], [1, 1]]), 2, [4, 2]) == [4, 4]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    check(registry.op12_embedding_whitening(spark, sf).collect(), [r.vec_id for r in given], integers([r.embedding for r in given]), 32)
