"""Brute force from the definitions, and comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
from itertools import combinations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def brute(rows, profits, k, min_pro, unpriced="exclude"):
    """The k best itemsets as (items, eu, ep): all subsets of all transactions."""
    of = {}
    for tid, item, quantity, prob in rows:
        if prob > 0 and (item in profits or unpriced == "zero"):
            of.setdefault(tid, {})[item] = (profits.get(item, 0.0) * quantity, prob)
    eu, miss = {}, {}
    for t in of.values():
        for n in range(1, len(t) + 1):
            for x in combinations(sorted(t), n):
                p = math.prod(t[i][1] for i in x)
                eu[x] = eu.get(x, 0.0) + sum(t[i][0] for i in x) * p
                miss[x] = miss.get(x, 1.0) * (1 - p)
    good = [(list(x), e, 1 - miss[x]) for x, e in eu.items() if e >= -1e-10 and 1 - miss[x] >= min_pro - 1e-10]
    return sorted(good, key=lambda r: (-round(r[1], 6), len(r[0]), r[0]))[:k]


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(shown(x) for x in v) + "]"
    return str(v)


def same_as_sql(frame, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(frame.columns)
    assert sorted(names) == cols
    want = sorted("|".join(shown(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    got = sorted("|".join(shown(r[c]) for c in cols) for r in frame.collect())
    assert got == want
