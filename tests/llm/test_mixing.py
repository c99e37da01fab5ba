import hashlib
import random

import pytest
from helpers import same_as_sql

from tallyrift.llm import mixing, registry

SCHEMA = "doc_id long, source string, text string, size int, target string, weight string"


def made(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "x", "y") for i, s, t in rows], SCHEMA)


def slow(rows, weights=(1.0, 2.0, 3.0), most=3):
    """The mix by hand: targets by sharing what is over again and again, one document after the other."""
    docs = [(i, s, len((t or "").split()), int(hashlib.sha256(f"13:{'' if i is None else i}".encode()).hexdigest()[:15], 16)) for i, s, t in rows]
    size = {}
    for _, s, n, _ in docs:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = sum(size.values()), set()
    while True:
        left = budget - sum(most * size[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left / open_weight * weight[s] > most * size[s]} if open_weight else set()
        if not over:
            break
        full |= over
    target = {s: float(most * size[s]) if s in full else left / open_weight * weight[s] for s in order}
    queue = []
    for s in order:
        so_far = 0
        for place in sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[0] is None, d[0] or 0, d[2])):
            so_far += place[2]
            if place[2] and target[s]:
                queue += [((c * size[s] + so_far) / target[s], s is None, s or "", c, so_far, place) for c in range(most)]
    taken, total = {}, 0
    for finish, _, _, _, _, d in sorted(queue, key=lambda q: q[:5]):
        total += d[2]
        if total > budget:
            break
        taken[d] = taken.get(d, 0) + d[2]
    return sorted(((d[0], d[2], size[d[1]], round(target[d[1]], 6), taken.get(d, 0)) for d in docs), key=str)


def got(frame):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_against_slow(spark, seed):
    r = random.Random(seed)
    sources = ["a", "b", "é", "Z", None, "tiny"]
    rows = [(i, r.choice(sources[:5]), r.choice(["", None, "w " * r.randint(1, 40), " x\ty\x0bz"])) for i in range(90)] + [(900, "tiny", "a b"), (None, "b", "q r s")]
    q = mixing.fair_queue(made(spark, rows), (1.0, 2.0, 3.0))
    found = mixing.mixed(q)
    assert got(found) == slow(rows)
    by_copy = mixing.mixture(q).collect()
    assert sum(x["size"] for x in by_copy) == sum(x.taken for x in found.collect()) and [x.finish for x in by_copy] == sorted(x.finish for x in by_copy)


def test_shares_and_reruns(spark):
    r = random.Random(9)
    rows = [(i, "abcdef"[min(r.randint(0, 11), 5)], "w " * r.randint(1, 30)) for i in range(3000)]  # f has half of all rows
    found = got(mixing.mixed(mixing.fair_queue(made(spark, rows), (1.0, 2.0, 3.0))))
    assert found == got(mixing.mixed(mixing.fair_queue(made(spark, rows).repartition(5), (1.0, 2.0, 3.0))))
    source = {i: s for i, s, _ in rows}
    for s in "abcdef":
        own = [x for x in found if source[x[0]] == s]
        assert abs(sum(x[4] for x in own) - own[0][3]) <= 60 and all(x[4] <= 3 * x[1] for x in own)


def test_few_rows(spark):
    q = mixing.fair_queue(made(spark, []), (1.0, 2.0))
    assert mixing.mixed(q).collect() == [] and mixing.mixture(q).collect() == []
    wordless = [(1, "a", ""), (2, None, None)]
    assert got(mixing.mixed(mixing.fair_queue(made(spark, wordless), (1.0,)))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    same = [(1, "a", "x y")] * 3
    assert sum(x[4] for x in got(mixing.mixed(mixing.fair_queue(made(spark, same), (1.0,))))) == 6


def test_given_weights(spark):
    rows = [(i, s, "w w w w") for i in range(50) for s in "abc"]
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    found = mixing.mixed(mixing.fair_queue(made(spark, rows), weights, share=0.5, keep=("source", "target"))).toDF("doc_id", "source", "kept", "size", "source_size", "target", "taken")
    taken = {r.source: r.t for r in found.selectExpr("source", "taken").groupBy("source").agg({"taken": "sum"}).toDF("source", "t").collect()}
    assert taken["c"] == 0 and abs(taken["a"] - 150) <= 4 and abs(taken["b"] - 150) <= 4


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    same_as_sql(registry.op13_source_mixing(spark, sf), registry.OP13_SQL, sf)
