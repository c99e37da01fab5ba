import random

import numpy as np
import pytest

from tallyrift.llm import jaccardjoin
from tallyrift.llm.shingles import shingle_set


def texts(seed=6):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    out = []
    for _ in range(60):
        base = r.choices(words, k=r.randrange(30, 120))
        for _ in range(r.randrange(1, 6)):
            copy = list(base)
            for _ in range(r.randrange(0, 5)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    hot = r.choices(words, k=100)
    for _ in range(40):  # a group of near copies
        copy = list(hot)
        copy[r.randrange(100)] = r.choice(words)
        out.append(" ".join(copy))
    return [*out, *[out[3]] * 30, out[5].upper(), None, "", " ", "!!", "one two", "One, two!", "one two three", "w " * 20000]


def brute(every):
    sets = [set(shingle_set(t).tolist()) for t in every]
    near = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-12] for i, a in enumerate(sets)]
    out = []
    for i in range(len(sets)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((i, len(near[i]), min(seen), i == min(seen)))
    return out


@pytest.mark.parametrize("rows", [1500, 7])
def test_against_brute_force(docs_of, monkeypatch, rows):
    monkeypatch.setattr(jaccardjoin, "SLICE_ROWS", rows)  # few rows: tied sets cut into slices
    every = texts()
    got = jaccardjoin.jaccard_links(docs_of(every)).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id, r.kept) for r in got) == brute(every)


def test_one_of_each(docs_of, spark):
    every = texts()
    kept = jaccardjoin.one_of_each(docs_of(every))
    assert kept.columns == docs_of(["a"]).columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in brute(every) if k]
    again = docs_of(["a b c d e f"] * 3 + ["", None], [1, 1, 2, 4, 4])
    assert sorted((r.doc_id, r.text or "") for r in jaccardjoin.one_of_each(again).collect()) == [(1, "a b c d e f"), (4, ""), (4, "")]
    assert jaccardjoin.jaccard_links(docs_of(["a"]).limit(0)).count() == 0


def test_texts_that_stay_are_not_moved(spark, docs_of):
    """Without broadcasts, too, only rows whose text is among those that go meet them; the filter lets few others through."""
    every = [f"text nr {i} has words {i * 7} of its own {i * i} and more {i * 13}" for i in range(3000)]
    every += every[:40] + [None, "", None]
    docs = docs_of(every)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccardjoin.one_of_each(docs)
        got = sorted(r.doc_id for r in kept.collect())
        gone = docs.where("doc_id < 40").selectExpr("md5(text) as gone")
        marks = {r.doc_id: r.maybe for r in jaccardjoin.with_mark(docs, "text", gone, "gone", "maybe").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert got == [*range(3000), *range(3040, 3043)]
    assert all(marks[i] for i in [*range(40), *range(3000, 3040)]) and sum(marks.values()) < 80 + 60
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "__mark_bits" in plan.split("Join LeftAnti")[1]


@pytest.mark.parametrize("crowd", [0, 10**6])
def test_long_and_short_prefixes_find_the_same(docs_of, crowd):
    every = texts(7)
    got = jaccardjoin.jaccard_links(docs_of(every), crowd=crowd).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id, r.kept) for r in got) == brute(every)


def test_prefixes_and_pairs():
    assert [jaccardjoin.trees_for(d, 0.8, 0.9999) for d in (4, 5, 6)] == [18, 24, 31]
    found = np.array([[900, 40, 3], [0, 0, 0], [90, 80, 70], [40, 10, 0]])  # by length 4, 5, 6
    assert jaccardjoin.prefix_lengths(found, 4, 32).tolist() == [6, 4, 6, 5]
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    a, b = jaccardjoin.similar_pairs(sets, 0.3)
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if len(np.intersect1d(sets[i], sets[j])) >= 0.3 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)
    a, b = jaccardjoin.similar_pairs(sets, 0.3, 30)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i, j in want if i < 30 <= j}
