"""Exact top-k by inner product: distances to pivots bound each candidate, best bounds are evaluated first.

Inner products become distances by one more coordinate, which gives all candidates the same norm.
By the triangle inequality, the largest difference of two rows' distances to a pivot bounds their own
distance from below. Each row's distances to all pivots are worked out once and kept in a table; the
pivots are rows far apart from each other. Candidates stand by their nearest pivot in blocks, whose least
and largest distances bound a whole block at once. A query's blocks are evaluated in the order of their
bounds until the next bound can't reach the k-th best score any more, so the result is exact whatever
the pivots are. The k-th best score of a fixed sample is known before, in all cells alike.

Vectors that are null or hold null or non-finite components take no part, neither as queries nor as
candidates; shorter vectors count as padded with zeros. A row is never its own candidate; repeated
rows are, also those that repeat its id. Ties go to the smaller id, null ids last. An empty table gives
no rows. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import partitions, release, stash

#: Rows of a cell: queries and candidates meet in cells of bounded size, whatever the data.
QUERY_ROWS, CANDIDATE_ROWS, LEAST_ROWS = 2048, 16384, 2048
#: Rows of the sample that gives pivots and first scores, of a block, and how many blocks are evaluated at once.
SAMPLE, BLOCK, BLOCKS = 1024, 64, 16


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return (np.concatenate(parts) if parts else np.zeros(0)).astype(dtype).reshape(-1, dim)


def far_apart(rows: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the rows, each the farthest from those chosen before it."""
    if not len(rows):
        return rows
    chosen, far = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(count, len(rows)):
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return rows[chosen]


def first_in_order(query: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k best, ties by order."""
    by = np.lexsort((order, -score, query))
    query = query[by]
    return by[np.arange(len(by)) - np.searchsorted(query, query) < k]


def search(
    q: np.ndarray, x: np.ndarray, own: np.ndarray, order: np.ndarray, dq: np.ndarray, dx: np.ndarray, top: float, k: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each query's best k rows of ``x`` (all, if fewer) that reach its ``floor``, as (query, row, score), and how many pairs were evaluated.

    ``own``: the row of x that is the query itself, or -1; ``order``: rank of each row's id, for ties;
    ``dq``, ``dx``: distances to the pivots; ``top``: the largest squared norm of all rows.
    """
    n, evaluated = len(x), 0
    near = dx.argmin(1)
    perm = np.lexsort((dx[np.arange(n), near], near))
    place = np.empty(n, np.int64)
    place[perm] = np.arange(n)
    x, dx, order = x[perm], dx[perm], order[perm]
    own = np.where(own >= 0, place[own], -1)
    begin = np.arange(0, n, BLOCK)
    low, high = np.minimum.reduceat(dx, begin), np.maximum.reduceat(dx, begin)
    norms = (q.astype(np.float64) ** 2).sum(1)
    slack = 1e-9 * (norms.max(initial=0) + top + 1)
    out = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, q.dtype)]]
    # Queries of one nearest pivot look at much the same blocks.
    ask_near = dq.argmin(1)
    by = np.argsort(ask_near, kind="stable")
    cuts = np.flatnonzero(np.diff(ask_near[by])) + 1
    for part in (g[k : k + 64] for g in np.split(by, cuts) for k in range(0, len(g), 64)):
        gap = np.zeros((len(q[part]), len(begin)))
        for p in range(dq.shape[1]):
            d = dq[part, p, None]
            np.maximum(gap, np.maximum(d - high[None, :, p], low[None, :, p] - d), out=gap)
        bound = (norms[part, None] + top - gap * gap) / 2 + slack  # no score of a block is above this
        least = floor[part].copy()
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, q.dtype)]
        todo = np.argsort(-bound.max(0), kind="stable")
        for lo in range(0, len(todo), BLOCKS):
            blocks = todo[lo : lo + BLOCKS]
            reach = bound[:, blocks] >= least[:, None]
            if not reach.any():
                continue
            blocks = blocks[reach.any(0)]
            ask = np.flatnonzero(reach.any(1))
            rows = (begin[blocks][:, None] + np.arange(BLOCK)).ravel()
            rows = rows[rows < n]
            score = q[part[ask]] @ x[rows].T
            evaluated += score.size
            i, j = np.nonzero(score >= least[ask][:, None])
            value, i, j = score[i, j], ask[i], rows[j]
            other = own[part[i]] != j
            found = [np.concatenate([a, b]) for a, b in zip(found, (i[other], j[other], value[other]), strict=True)]
            best = first_in_order(found[0], found[2], order[found[1]], k)
            found = [c[best] for c in found]
            count = np.bincount(found[0], minlength=len(least))
            full = np.flatnonzero(count == k)
            least[full] = np.maximum(least[full], found[2][np.cumsum(count)[full] - 1])
        out.append([part[found[0]], perm[found[1]], found[2]])
    i, j, score = (np.concatenate(c) for c in zip(*out, strict=True))
    return i, j, score, evaluated


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, pivots: int = 64
) -> DataFrame:
    """query_id, rank, ``id_col``, score: for each query row the k largest inner products of floor(scale * x)."""
    spark = vectors.sparkSession
    v = F.col(f"`{vec_col}`")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.when(fine, F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("double"))).alias("v"),
    ).where("v is not null")
    raw = stash(rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)), "vectors")
    said = raw.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), F.max("norm")).first()
    count, asked, dim, top = said[0], said[1], said[2] or 0, said[3] or 0.0
    dim = max(dim, 1)
    exact = np.float64 if top < 2**52 else np.int64  # doubles hold all products and sums below that
    wide = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))
    rows = raw.withColumn("v", F.when(F.size("v") == dim, F.col("v")).otherwise(wide))
    # ``SAMPLE`` rows, a fixed number; which ones is of no matter for the result.
    some = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "v").collect()
    sample = np.array([r["v"] for r in some]).reshape(-1, dim)
    piv = far_apart(sample, pivots)
    held = spark.sparkContext.broadcast((sample.astype(exact), np.array([r["row"] for r in some], np.int64), piv, np.sqrt(np.maximum(top - (piv**2).sum(1), 0))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's distances to the pivots, as a candidate and as a query, and its k-th score of the sample."""
        sample, sample_row, p, p_up = held.value
        pn = (p**2).sum(1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = _matrix(batch.column(3), dim)
                xn = (x**2).sum(1)
                flat = xn[:, None] + pn[None] - 2 * x @ p.T
                dx = np.sqrt(np.maximum(flat + (np.sqrt(np.maximum(top - xn, 0))[:, None] - p_up[None]) ** 2, 0))
                dq = np.sqrt(np.maximum(flat + p_up[None] ** 2, 0))
                ask = batch.column(2).to_numpy(zero_copy_only=False)
                floor = np.full(len(x), np.iinfo(np.int64).min)
                if len(sample) > k and ask.any():
                    score = x[ask].astype(exact) @ sample.T
                    score[batch.column(1).to_numpy()[ask][:, None] == sample_row[None]] = score.min(initial=0) - 1
                    floor[ask] = np.partition(score, len(sample) - k, 1)[:, len(sample) - k]
                lists = lambda d, keep: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep * d.shape[1])), pa.int32()), pa.array(d[keep].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], lists(dx, np.ones(len(x), bool)), lists(dq, ask), pa.array(floor)], ["vec_id", "row", "asks", "v", "dx", "dq", "floor"]
                )

    table = stash(
        rows.select("vec_id", "row", "asks", "v").mapInArrow(measure, "vec_id bigint, row bigint, asks boolean, v array<double>, dx array<double>, dq array<double>, floor bigint"), "measured"
    )
    release(raw)
    q_blocks = max(1, -(-asked // QUERY_ROWS))
    x_blocks = max(1, -(-count // CANDIDATE_ROWS), min(-(-partitions(spark) // q_blocks), -(-count // LEAST_ROWS)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = table.where("asks").select("vec_id", "row", "v", "dq", "floor", block(q_blocks).alias("qb"), every(x_blocks).alias("xb"))
    own = [F.col(c).alias(c) for c in ("vec_id", "row", "v", "dx")]  # columns of their own, for the cogroup
    cands = table.select(*own, block(x_blocks).alias("xb"), every(q_blocks).alias("qb"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "query_row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        q, x = _matrix(left.column("v"), dim, exact), _matrix(right.column("v"), dim, exact)
        width = held.value[2].shape[0]
        q_row, x_row = left.column("row").to_numpy(), right.column("row").to_numpy()
        at = np.argsort(x_row)
        spot = at[np.minimum(np.searchsorted(x_row[at], q_row), len(at) - 1)]
        same = np.where(x_row[spot] == q_row, spot, -1)
        last = right.column("vec_id").is_null().to_numpy()
        order = np.empty(len(x), np.int64)
        order[np.lexsort((x_row, right.column("vec_id").fill_null(0).to_numpy(), last))] = np.arange(len(x))
        i, j, score, _ = search(q, x, same, order, _matrix(left.column("dq"), width), _matrix(right.column("dx"), width), top, k, left.column("floor").to_numpy().astype(exact))
        take = lambda t, c, r: t.column(c).take(pa.array(r, pa.int64()))
        return pa.table({"query_id": take(left, "vec_id", i), "query_row": take(left, "row", i), "vec_id": take(right, "vec_id", j), "row": take(right, "row", j), "score": pa.array(score.astype(np.int64))})

    found = asks.groupBy("qb", "xb").cogroup(cands.groupBy("qb", "xb")).applyInArrow(
        cell, "query_id bigint, query_row bigint, vec_id bigint, row bigint, score bigint"
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("vec_id").alias(id_col), "score"
    )
