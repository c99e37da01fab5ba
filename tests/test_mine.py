import math
import random

import pytest

from helpers import brute
from pyspark.sql import functions as F

from tallyrift.operators import encode
from tallyrift.plans import dense
from tallyrift.plans import mine as search
from tallyrift.plans.mine import mine, mine_settings

TX = "tid long, item int, quantity int, prob double"
SAMPLE = [
    (1, 2, 3, 0.85), (1, 3, 1, 1.0), (1, 4, 2, 0.70), (2, 1, 1, 1.0), (2, 2, 1, 0.60), (2, 3, 3, 0.75), (3, 1, 1, 0.55), (3, 2, 2, 0.60), (3, 3, 4, 1.0),
    (3, 4, 1, 0.90), (3, 5, 5, 0.40), (4, 2, 3, 0.90), (4, 4, 1, 0.45), (5, 1, 4, 1.0), (5, 3, 3, 0.85), (5, 4, 2, 0.70), (5, 5, 2, 0.45),
]
SAMPLE_PROFITS = {1: 6.0, 2: 7.0, 3: 1.0, 4: -5.0, 5: 3.0}


def run(spark, rows, profits, k, min_pro, **options):
    p = spark.createDataFrame(list(profits.items()), "item int, profit double")
    return mine(spark.createDataFrame(rows, TX), p, k, min_pro, **options)


def check(found, want):
    assert [r[0] for r in found.rows] == [r[0] for r in want]
    for a, b in zip(found.rows, want, strict=True):
        assert a[1] == pytest.approx(b[1], abs=1e-9) and a[2] == pytest.approx(b[2], abs=1e-12)


@pytest.mark.parametrize(("k", "min_pro", "n"), [(100, 0.001, 29), (5, 0.1, 5), (100, 0.5, 17)])
def test_sample(spark, k, min_pro, n):
    found = run(spark, SAMPLE, SAMPLE_PROFITS, k, min_pro)
    assert len(found.rows) == n
    check(found, brute(SAMPLE, SAMPLE_PROFITS, k, min_pro))
    assert found.rows[0][0] == [2] and found.rows[0][1] == pytest.approx(49.35)


def test_mixed_signs_keep_what_looks_hopeless(spark):
    rows = [(1, 2, 4, 0.5), (1, 3, 2, 0.2), (1, 4, 3, 1.0), (2, 2, 1, 0.9), (2, 3, 4, 0.2), (3, 3, 2, 1.0), (4, 1, 2, 0.9), (4, 2, 1, 0.5), (4, 4, 2, 0.9)]
    found = run(spark, rows, {1: -9.0, 2: 6.0, 3: 6.0, 4: -9.0}, 5, 0.0)
    assert [(r[0], round(r[1], 6)) for r in found.rows] == [([2], 20.4), ([3], 19.2), ([2, 3], 9.0), ([2, 3, 4], 0.9)]


def test_positive_only(spark):
    rows = [(1, 1, 3, 0.5), (1, 2, 2, 0.9), (1, 3, 2, 1.0), (1, 4, 3, 1.0), (2, 3, 2, 0.9)]
    found = run(spark, rows, {1: 3.0, 2: 1.0, 3: 3.0, 4: 6.0}, 2, 0.0)
    assert [(r[0], round(r[1], 6)) for r in found.rows] == [([3, 4], 24.0), ([2, 3, 4], 23.4)]


@pytest.mark.parametrize("seed", range(6))
def test_random_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(t, i, r.randint(1, 5), r.choice([0.1, 0.3, 0.5, 0.9, 1.0, 0.0])) for t in range(7) for i in range(1, 7) if r.random() < 0.6]
    profits = {i: float(r.choice([-6, -2, 0, 1, 4, 8])) for i in range(1, 6)}
    k, min_pro = r.choice([2, 6, 20]), r.choice([0.0, 0.2, 0.6])
    options = [{}, {"weighted": False}, {"pairs": True}, {"unpriced": "zero"}][seed % 4]
    check(run(spark, rows, profits, k, min_pro, **options), brute(rows, profits, k, min_pro, options.get("unpriced", "exclude")))


def test_larger_k_extends_and_higher_probability_removes(spark):
    few, many = run(spark, SAMPLE, SAMPLE_PROFITS, 4, 0.1).rows, run(spark, SAMPLE, SAMPLE_PROFITS, 12, 0.1).rows
    assert [r[0] for r in few] == [r[0] for r in many[:4]]
    strict = {tuple(r[0]) for r in run(spark, SAMPLE, SAMPLE_PROFITS, 100, 0.6).rows}
    assert strict <= {tuple(r[0]) for r in run(spark, SAMPLE, SAMPLE_PROFITS, 100, 0.1).rows}


def test_max_len_statistics_and_frames(spark):
    found = run(spark, SAMPLE, SAMPLE_PROFITS, 100, 0.001, max_len=2)
    assert max(len(r[0]) for r in found.rows) == 2
    stats = found.stats(spark).collect()
    assert [s.level for s in stats] == [1, 2] and all(s.candidates >= s.survivors for s in stats)
    assert [r.rank for r in found.frame(spark).collect()] == list(range(1, len(found.rows) + 1))


def test_nothing_and_bad_k(spark):
    assert run(spark, [], {1: 1.0}, 3, 0.1).rows == []
    with pytest.raises(ValueError):
        run(spark, SAMPLE, SAMPLE_PROFITS, 0, 0.1)


def recounted(rows, profits, k, min_pro):
    """The levels of the search once more, from their definition: dictionaries, one itemset at a time."""
    of = {}
    for tid, item, quantity, prob in rows:
        if prob > 0 and item in profits:
            of.setdefault(tid, {})[item] = (profits[item] * quantity, prob)
    rtu = {t: sum(max(u, 0.0) for u, _ in x.values()) for t, x in of.items()}
    bound, single = {}, {}
    for t, x in of.items():
        for i, (u, p) in x.items():
            bound[i] = bound.get(i, 0.0) + rtu[t] * p
            eu, miss = single.get(i, (0.0, 1.0))
            single[i] = (eu + u * p, miss * (1 - p))
    seeds = sorted((eu for i, (eu, miss) in single.items() if bound[i] > 0 and 1 - miss >= min_pro - 1e-10 and eu >= -1e-10), reverse=True)
    threshold = max(0.0, seeds[k - 1]) if len(seeds) >= k else 0.0
    usable = {i for i, (_, miss) in single.items() if bound[i] > 0 and 1 - miss >= min_pro - 1e-10 and bound[i] >= threshold - 1e-6}
    order = {t: sorted(usable & x.keys(), key=lambda i: (bound[i], i)) for t, x in of.items()}
    level, best, out = {(i,) for i in usable}, [], []
    while True:
        sums = {}
        for t, items in order.items():
            for x in level:
                if set(x) <= set(items):
                    u, p = sum(of[t][i][0] for i in x), math.prod(of[t][i][1] for i in x)
                    rem = sum(max(of[t][i][0], 0.0) for i in items[items.index(x[-1]) + 1 :])
                    eu, miss, ub = sums.get(x, (0.0, 1.0, 0.0))
                    sums[x] = (eu + u * p, miss * (1 - p), ub + max(u + rem, 0.0) * p)
        good = [(sorted(x), eu, 1 - miss) for x, (eu, miss, _) in sums.items() if 1 - miss >= min_pro - 1e-10 and eu >= (threshold - 1e-6 if threshold > 0 else -1e-10)]
        best = sorted(best + good, key=lambda r: (-round(r[1], 6), len(r[0]), r[0]))[:k]
        if len(best) == k:
            threshold = max(threshold, best[-1][1], 0.0)
        likely = {x for x, (_, miss, _) in sums.items() if 1 - miss >= min_pro - 1e-10}
        grow = {x for x in likely if sums[x][2] >= threshold - 1e-6}
        out.append((len(out) + 1, len(sums), len(sums) - len(likely), len(likely) - len(grow), len(grow), round(threshold, 6)))
        if not grow:
            return out
        level = {(*x, i) for items in order.values() for x in grow if set(x) <= set(items) for i in items[items.index(x[-1]) + 1 :] if bound[i] >= threshold - 1e-6}


@pytest.mark.parametrize("k", [3, 10, 40])
def test_level_counts(spark, k):
    r = random.Random(k)
    rows = [(t, i, r.randint(1, 9), r.choice([0.2, 0.5, 0.9, 1.0])) for t in range(30) for i in r.sample(range(1, 9), r.randint(1, 6))]
    profits = {i: float(r.choice([-6, -2, 1, 3, 7])) for i in range(1, 9)}
    found = run(spark, rows, profits, k, 0.3)
    want = recounted(rows, profits, k, 0.3)
    assert [(x["level"], x["candidates"], x["ep_pruned"], x["ub_pruned"], x["survivors"], round(x["threshold"], 6)) for x in found.levels] == want
    assert all(x["occurrences"] >= x["candidates"] and x["pair_pruned"] == 0 and x["batches"] == 1 and x["peak_memory_mb"] > 0 for x in found.levels)
    check(found, brute(rows, profits, k, 0.3))


def many(seed, transactions=60, items=9, most=7):
    r = random.Random(seed)
    rows = [(t, i, r.randint(1, 9), r.choice([0.2, 0.5, 0.9, 1.0])) for t in range(transactions) for i in r.sample(range(1, items + 1), r.randint(1, most))]
    return rows, {i: float(r.choice([-6, -2, 1, 3, 7])) for i in range(1, items + 1)}


def test_an_item_twice_is_an_error(spark):
    with pytest.raises(Exception, match="a transaction has an item twice: 1"):
        run(spark, [(1, 1, 1, 0.5), (1, 1, 2, 0.5), (2, 1, 1, 0.5)], {1: 1.0}, 3, 0.0)


SETTINGS = [(3, 0.0), (10, 0.3), (50, 0.3), (5, 0.7), (2, 0.99)]


@pytest.mark.parametrize("pairs", [False, True])
def test_settings_share_a_search(spark, pairs):
    rows, profits = many(3)
    tx, p = spark.createDataFrame(rows, TX), spark.createDataFrame(list(profits.items()), "item int, profit double")
    found = mine_settings(tx, p, SETTINGS, pairs=pairs)
    for (k, min_pro), one in zip(SETTINGS, found, strict=True):
        check(one, brute(rows, profits, k, min_pro))
    assert len({tuple((x["level"], x["candidates"]) for x in m.levels) for m in found}) == 1  # the same levels
    with pytest.raises(ValueError):
        mine_settings(tx, p, [])


def test_pairs_prune_at_every_level(spark):
    rows, profits = many(5, 90, 12, 7)
    plain, paired = (run(spark, rows, profits, 10, 0.05, pairs=x) for x in (False, True))
    check(paired, plain.rows)
    of = lambda m, name: {x["level"]: x[name] for x in m.levels}
    assert sum(of(paired, "pair_pruned").values()) > 0 and all(of(paired, "candidates")[n] <= c for n, c in of(plain, "candidates").items() if n in of(paired, "candidates"))
    assert sum(n for level, n in of(paired, "candidates").items() if level > 2) < sum(n for level, n in of(plain, "candidates").items() if level > 2)


def test_threshold_rises_within_a_level(spark, monkeypatch):
    rows, profits = many(7, 90, 12, 6)
    plain = run(spark, rows, profits, 12, 0.05)
    monkeypatch.setattr(search, "BATCH_FROM", 3)
    batched = run(spark, rows, profits, 12, 0.05)
    check(batched, plain.rows)
    assert max(x["batches"] for x in batched.levels) > 1
    assert sum(x["candidates"] for x in batched.levels) <= sum(x["candidates"] for x in plain.levels)


@pytest.mark.parametrize("pairs", [False, True])
def test_survivors_beyond_a_broadcast(spark, pairs):
    rows, profits = many(9, 40, 9, 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = run(spark, rows, profits, 30, 0.05, pairs=pairs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(x["level"] for x in found.levels) >= 4  # beyond a level that is written out
    check(found, brute(rows, profits, 30, 0.05))


def test_no_shuffle_of_lists(spark):
    rows, profits = many(9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        priced = encode.priced(spark.createDataFrame(rows, TX), spark.createDataFrame(list(profits.items()), "item int, profit double")).withColumn("bound", F.lit(1.0))
        tails = encode.as_tails(priced, "bound", "item")
        keep = spark.createDataFrame([([1],), ([2],)], "items array<int>")
        plan = search.extended_by_join(search.first_level(tails), keep, tails)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The lists are made behind the one shuffle of transactions; what is shuffled from there on has none of them.
    assert plan.count("Exchange") >= 3
    for line in plan.split("\n"):
        if "Exchange" in line:
            assert "t_" not in line


def test_nothing_is_left_behind(spark):
    from tallyrift.sources.shared import shared_dir

    rows, profits = many(9, 40, 9, 6)
    run(spark, rows, profits, 30, 0.05)
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{sc.applicationId}")
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    assert not [n for n in names if n.startswith(("level-", "alive-"))]
    assert not spark._jsparkSession.sharedState().cacheManager().cachedData().mkString("").count("t_rem")


@pytest.mark.parametrize("min_pro", [0.0, 0.3])
def test_columns_give_the_same(spark, monkeypatch, min_pro):
    monkeypatch.setattr(dense, "CLASS", 2)
    monkeypatch.setattr(dense, "BLOCK_CELLS", 64)
    rows, profits = many(11, 60, 8, 7)
    check(run(spark, rows, profits, 25, min_pro, columns=True), brute(rows, profits, 25, min_pro))
    # Too many survivors for a broadcast from some level on: back to rows.
    limit, calls = search._fits, []
    monkeypatch.setattr(search, "_fits", lambda s, n, size: calls.append(size) or (limit(s, n, size) and size != 2))
    check(run(spark, rows, profits, 25, min_pro, columns=True), brute(rows, profits, 25, min_pro))
    assert 3 in calls


def test_columns_are_chosen_where_data_is_dense(spark, monkeypatch):
    asked = []
    real = dense.measured
    monkeypatch.setattr(dense, "measured", lambda *a: asked.append(len(a[1])) or real(*a))
    rows = [(t, i, 1 + (t * i) % 4, 0.9) for t in range(40) for i in range(1, 8) if (t + i) % 6]
    profits = {i: float(i - 2) for i in range(1, 8)}
    found = run(spark, rows, profits, 15, 0.1)
    assert asked
    check(found, brute(rows, profits, 15, 0.1))
    asked.clear()
    sparse, some = many(13, 60, 40, 2)
    check(run(spark, sparse, some, 15, 0.1), brute(sparse, some, 15, 0.1))
    assert not asked and dense.pays(1000, 50, 40000, 75, 37.0) and not dense.pays(1000, 50, 400, 4000, 8.0) and not dense.pays(10, 1, 10, 5000, 5000.0)
