import math

import numpy as np
import pytest

from tallyrift.llm import vectordup
from tallyrift.llm.components import components


def brute(rows, least):
    good = {n: np.array(v, float) for n, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {n: v / np.linalg.norm(v) for n, v in good.items()}
    near = {n: [m for m in unit if m != n and unit[m] @ unit[n] >= least] if n in unit else [] for n in range(len(rows))}
    out = []
    for n, (i, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((i, len(near[n]), min(rows[m][0] for m in seen)))
    return sorted(out)


def vectors(seed=1, n=500, dim=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    for i in range(0, n - 1, 3):  # chains and groups of near copies
        base[i + 1] = base[i] + r.standard_normal(dim) * r.choice([0.1, 0.3, 0.45])
    for i in range(60):
        base[100 + i] = base[99] + r.standard_normal(dim) * 0.08
    rows = [(i, v.tolist()) for i, v in enumerate(base.astype(np.float32).astype(float))]
    rows += [(5000 + i, rows[7][1]) for i in range(40)] + [(6000, (np.array(rows[7][1]) * 2).tolist())]
    return [*rows, (7000, None), (7001, [0.0] * dim), (7002, [None] * dim), (7003, [math.nan] * dim)]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # strips cut into many slices
        monkeypatch.setattr(vectordup, "HOME_ROWS", 40)
        monkeypatch.setattr(vectordup, "VISIT_ROWS", 70)
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, row int, v string")
    got = vectordup.near_duplicates(frame, 0.9, 4).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.9)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.01]), (5, [3.0]), (6, [4.0]), (6, [-4.0])]
    got = vectordup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 0, 6), (6, 1, 5)]


def test_each_pair_is_found_once_over_the_blocks():
    rows, found = 2000, []
    r = np.random.default_rng(5)
    x = r.standard_normal((rows, 64))
    x[1::50] = x[::50] + r.standard_normal((rows // 50, 64)) * 0.3
    unit, ids = x / np.linalg.norm(x, axis=1)[:, None], np.arange(rows)
    for block in range(8):
        line = (unit @ vectordup.rotation(64))[:, 8 * block]
        i, j = vectordup.links_in_cell(x, x, line, line, ids, ids, block, 8, 0.9)
        found += [(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    assert sorted(found) == list(zip(a.tolist(), b.tolist(), strict=True)) and len(found) > 10


def test_vectors_are_written_twice_at_most(spark, monkeypatch):
    """Blocks and strips get their copies by shuffle alone; a row goes to a cell once, at home and on visit alike."""
    written, stash = {}, vectordup.stash
    monkeypatch.setattr(vectordup, "stash", lambda df, name: written.setdefault(name, stash(df, name)))
    rows = [(i, v) for i, v in vectors() if v is not None]
    found = vectordup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.count() == len(rows)
    assert [n for n, t in written.items() if "v" in t.columns] == ["vectors", "classes"]


def test_nothing(spark):
    assert vectordup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
