"""Embedding near-duplicates: a subspace pigeonhole join, every candidate verified.

Unit vectors with a cosine of at least t are no further apart than sqrt(2 - 2t). If a rotated vector
is split into m blocks, at least one block of such a pair has at most an m-th of the squared
distance. So each block is joined by range under that budget, and a pair found is verified with the
whole vectors; of the blocks that find it, the first counts it.

The range join of a block goes by strips of its first coordinate, twice the range wide: a row lives in
its own strip and visits the one before if it is in range of that. Each row looks for rows that follow
it on that line only, so a pair meets once. A strip of many rows is cut into slices, and each pair of
slices is one task, so none holds more than ``HOME_ROWS`` and ``VISIT_ROWS`` rows. Strips are counted
first and their rows dealt straight to such tasks: no copy but the shuffle's is written.

Equal vectors are one class, joined once, however many there are. Vectors that are null, zero or hold
null or non-finite components link with nothing; those of each length are joined with each other. Rows
that repeat an id are rows of their own. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import release, stash
from .components import components

HOME_ROWS, VISIT_ROWS = 1 << 18, 1 << 19
#: Rows whose products with a chunk of rows are looked at together: they fit a core's cache.
TILE = 8192


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation, so that no block has most of the length."""
    return np.linalg.qr(np.random.default_rng(20240607).standard_normal((dim, dim)))[0]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return (np.concatenate(parts) if parts else np.zeros(0)).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _in_block(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The unit vectors' coordinates in a block, made in parts, so that no copy of all vectors in double precision is held."""
    return np.concatenate([np.zeros((0, turn.shape[1]), np.float32), *[(_unit(x[k : k + 65536]) @ turn).astype(np.float32) for k in range(0, len(x), 65536)]])


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; ``parent`` holds each row's root, before and after."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def links_in_cell(
    home: np.ndarray, visit: np.ndarray, home_line: np.ndarray, visit_line: np.ndarray, home_id: np.ndarray, visit_id: np.ndarray,
    block: int, blocks: int, least: float, chunk: int = 128,
) -> tuple[np.ndarray, np.ndarray]:
    """The links (home row, visiting row) of rows that follow on the line, if ``block`` is the first to find them."""
    turn = rotation(home.shape[1])
    edges = np.linspace(0, home.shape[1], blocks + 1).astype(int)
    lo, hi = edges[block], edges[block + 1]
    budget = (2 - 2 * least) / blocks * (1 + 1e-9) + 1e-12
    reach = np.sqrt(budget) * (1 + 1e-9)
    order, at_home = np.argsort(visit_line), np.argsort(home_line)
    line = visit_line[order]
    small_v, small_h = _in_block(visit, turn[:, lo:hi])[order], _in_block(home, turn[:, lo:hi])
    half_v, half_h = (small_v**2).sum(1) / 2, ((small_h**2).sum(1) - np.float32(budget + 1e-4)) / 2
    first_out, second_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(home), chunk):
        own = at_home[at : at + chunk]
        first, last = np.searchsorted(line, home_line[own[0]]), np.searchsorted(line, home_line[own[-1]] + reach, "right")
        for start in range(first, last, TILE):
            end = min(start + TILE, last)
            # Half of (sum of squares - budget) against the product: one pass less over the matrix.
            near = small_h[own] @ small_v[start:end].T >= half_h[own, None] + half_v[None, start:end]
            i, j = np.nonzero(near)
            i, j = own[i], order[start + j]
            for k in range(0, len(i), 1 << 15):
                a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                after = (visit_line[b] > home_line[a]) | ((visit_line[b] == home_line[a]) & (visit_id[b] > home_id[a]))
                a, b = a[after], b[after]
                h, v = _unit(home[a]), _unit(visit[b])
                true = np.einsum("ij,ij->i", h, v) >= least
                a, b = a[true], b[true]
                if len(a):
                    subs = np.add.reduceat(np.einsum("ij,jk->ik", h[true] - v[true], turn) ** 2, edges[:-1], axis=1)
                    mine = (subs <= budget).argmax(1) == block
                    first_out.append(a[mine])
                    second_out.append(b[mine])
    return np.concatenate(first_out), np.concatenate(second_out)


def length_links(classes: DataFrame, dim: int, least: float, blocks: int) -> DataFrame:
    """cls, links, up: parts of the links and of a forest of them, of classes (v, cls, weight) whose vectors have ``dim`` components."""
    wide = 2 * float(np.sqrt((2 - 2 * least) / blocks * (1 + 1e-9) + 1e-12))

    def strips(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool]]:
        """Block, rows, strips and lines: each row once at home, and in the strip it visits, for each block."""
        firsts = _unit(_matrix(batch.column(0), dim)) @ rotation(dim)[:, np.linspace(0, dim, blocks + 1).astype(int)[:-1]]
        for b in range(blocks):
            strip = np.floor(firsts[:, b] / wide).astype(np.int64)
            guests = np.flatnonzero(firsts[:, b] - strip * wide <= wide / 2 * (1 + 1e-6))
            for step, took in ((0, np.arange(len(firsts))), (-1, guests)):
                yield b, took, strip[took] + step, firsts[took, b], step == 0

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (whole.slice(at, 4096) for whole in batches for at in range(0, whole.num_rows, 4096))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for b, _, strip, _, home in strips(batch):
                names, n = np.unique(strip, return_counts=True)
                columns = [np.full(len(n), b, np.int32), names, n * home, n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "strip", "homes", "every"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for b, took, strip, line, home in strips(batch):
                n = len(took)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b, np.int32)), pa.array(strip), pa.array(np.full(n, home)), pa.array(line), *batch.take(pa.array(took)).columns],
                    ["block", "strip", "home", "line", "v", "cls", "weight"],
                )

    kind = next(t for n, t in classes.dtypes if n == "v")
    # A row for each strip, of which a block has few: they are as wide as twice the range.
    sums = classes.select("v").mapInArrow(count, "block int, strip bigint, homes bigint, every bigint").groupBy("block", "strip").agg(F.sum("homes").alias("homes"), F.sum("every").alias("every"))
    sums = sums.where("homes > 0").select(
        "block", "strip", F.ceil(F.col("homes") / HOME_ROWS).cast("int").alias("hs"), F.ceil(F.col("every") / VISIT_ROWS).cast("int").alias("vs")
    )
    dealt = classes.select("v", "cls", "weight").mapInArrow(deal, f"block int, strip bigint, home boolean, line double, v {kind}, cls bigint, weight bigint")
    slice_of = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(n)).cast("int")
    cut = dealt.join(F.broadcast(sums), ["block", "strip"]).withColumn("own_h", slice_of("hs", 1)).withColumn("own_w", slice_of("vs", 2))
    # Each pair of slices is a cell; a row that is of both goes there once.
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda h, w: F.struct(h.alias("h"), w.alias("w"))
    at_home = F.when(F.col("home"), F.transform(every("vs"), lambda w: pair(F.col("own_h"), w))).otherwise(F.array().cast("array<struct<h:int,w:int>>"))
    cells = F.explode(F.array_union(at_home, F.transform(every("hs"), lambda h: pair(h, F.col("own_w")))))
    sent = cut.withColumn("cell", cells).select(
        "block", "strip", "cell.h", "cell.w", (F.col("home") & (F.col("own_h") == F.col("cell.h"))).alias("homes"), (F.col("own_w") == F.col("cell.w")).alias("visits"),
        "line", "v", "cls", "weight",
    )

    def links(key: tuple, rows: pa.Table) -> pa.Table:
        at_home, on_visit = (np.flatnonzero(rows.column(c).to_numpy()) for c in ("homes", "visits"))
        ids, line, weight = (rows.column(c).to_numpy() for c in ("cls", "line", "weight"))
        x = _matrix(rows.column("v"), dim)
        i, j = links_in_cell(x[at_home], x[on_visit], line[at_home], line[on_visit], ids[at_home], ids[on_visit], key[0].as_py(), blocks, least)
        ids, place = np.unique(ids, return_inverse=True)
        n = (weight[at_home[i]], weight[on_visit[j]])
        i, j = place[at_home[i]], place[on_visit[j]]
        count, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        np.add.at(count, i, n[1])
        np.add.at(count, j, n[0])
        union(parent, i, j)
        some = np.flatnonzero(count)
        return pa.table({"cls": pa.array(ids[some]), "links": pa.array(count[some]), "up": pa.array(ids[parent[some]])})

    return sent.groupBy("block", "strip", "h", "w").applyInArrow(links, "cls bigint, links bigint, up bigint")


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, blocks: int = 8, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``id_col``, n_links, component_id, kept: one row per vector, linked where the cosine is at least ``least``."""
    v = F.col(f"`{vec_col}`")
    whole = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    length = F.aggregate(F.transform(v, lambda c: c.cast("double") * c.cast("double")), F.lit(0.0), lambda a, c: a + c)
    rows = stash(
        vectors.select(
            F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"),
            F.when(whole & (length > 0) & (length < float("inf")), v).alias("v"),
        ),
        "vectors",
    )
    classes = stash(rows.where("v is not null").groupBy("v").agg(F.min("row").alias("cls"), F.count("*").alias("weight")), "classes")
    # Vectors of each length by themselves; there are few lengths, mostly one.
    lengths = [r[0] for r in classes.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    every = [length_links(classes.where(F.size("v") == n), n, least, min(blocks, n)) for n in lengths]
    none = rows.sparkSession.createDataFrame([], "cls bigint, links bigint, up bigint")
    found = stash(reduce(DataFrame.unionByName, every, none), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comp = stash(components(found.select(F.col("cls").alias("a"), F.col("up").alias("b"))), "components")
    of_class = (
        classes.join(links, "cls", "left").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
        .select("v", "cls", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component"))
    )
    # Rows that link with nothing join nothing; they are not sent to one place as null keys.
    known = rows.where("v is not null").join(of_class, "v").select("id", "row", "weight", "links", "component")
    known = stash(known.unionByName(rows.where("v is null").select("id", "row", F.col("row").alias("component")), allowMissingColumns=True), "members")
    smallest = stash(known.groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    release(rows, classes, found, comp)
    return known.join(smallest, "component").select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
