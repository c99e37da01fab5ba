"""Whitening of embeddings by TSQR: no covariance is formed.

Entries become integers, so the sums that centre the rows are exact. Each partition turns its centred rows
into the triangular factor R of their QR decomposition, block by block; R factors are stacked and
decomposed again in a tree of ``FAN_IN`` children a node, until one is left. Its singular values and right
vectors are those of all centred rows: eigenvalues of the covariance are the squared singular values
over the number of rows, its eigenvectors the right vectors. An R factor has as many rows as a vector
has entries, however many vectors there are; one, the sums and the components are all that the driver sees.

Rows whose vector is null or holds null or non-finite entries are dropped, as are those with an entry
beyond ``LARGEST``, whose integers doubles don't hold. Shorter vectors, also empty ones, count as padded with
zeros up to the longest. Repeated rows count as often as they are there; null ids are ids like others.
Components without variance (``TINY`` of the largest or less: constant entries, fewer rows than entries)
can't be scaled to 1 and are left out; a table of equal rows, or an empty one, gives no rows. A deviation
beyond the range of long integers is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .base import release, stash

SCALE, SHIFT, FAN_IN, BLOCK = 64, 1_000_000, 8, 4096
LARGEST, TINY = 2.0**40, 1e-24
LONG = 2**63


@dataclass
class Whitening:
    """``sums``: exact sums of the integer entries; ``values``: eigenvalues, falling; ``vectors``: a column each; ``trace``: of the covariance."""

    count: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vec_col: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST)
    return F.col(vec_col).isNotNull() & ~F.exists(F.coalesce(vec_col, F.array().cast("array<double>")), lambda x: F.coalesce(bad(x.cast("double")), F.lit(True)))


def _entries(column: pa.Array, dim: int) -> np.ndarray:
    """The integers of a batch of vectors, a row each: floor(64 * c) + 1000000."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.full((len(lengths), dim), SHIFT, np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x[np.repeat(np.arange(len(lengths)), lengths), at] = np.floor(SCALE * flat).astype(np.int64) + SHIFT
    return x


def _off(x: np.ndarray, count: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """What entries are above their mean, in two parts that are exact: whole numbers, and count-ths to be taken off them."""
    mean = [s // count for s in sums]
    return x - np.array(mean, np.int64), np.array([s - m * count for s, m in zip(sums, mean, strict=True)], np.int64)


def _centred(x: np.ndarray, count: int, sums: list[int]) -> np.ndarray:
    whole, part = _off(x, count, sums)
    return whole - part / count


def triangle(parts: list[np.ndarray]) -> np.ndarray:
    """R of the stacked parts, square."""
    rows = np.vstack(parts)
    if len(rows) < rows.shape[1]:
        rows = np.vstack([rows, np.zeros((rows.shape[1] - len(rows), rows.shape[1]))])
    return np.linalg.qr(rows, mode="r")


def _packed(node: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([node], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["node", "r"])


def tsqr(factors: DataFrame, dim: int) -> np.ndarray:
    """R of all rows from the R factors (node: long from 0, r: binary) of parts of them, merged in a tree.

    A node merges the factors of ``FAN_IN`` children at most, so a task holds no more than these. Parts that
    have no rows have no factor; without any, R is zero.
    """

    def merged(children: pa.Table) -> pa.Table:
        order = np.argsort(children["node"].to_numpy())
        parts = [np.frombuffer(children["r"][int(i)].as_py(), "<f8").reshape(dim, dim) for i in order]
        return pa.Table.from_batches([_packed(children["node"][0].as_py() // FAN_IN, triangle(parts))])

    level = stash(factors, "r-factors")
    while True:
        most = level.agg(F.max("node")).first()[0]
        if most is None or most == 0:
            break
        above = stash(level.groupBy(F.floor(F.col("node") / FAN_IN).alias("above")).applyInArrow(merged, "node long, r binary"), "r-factors")
        release(level)
        level = above
    found = level.first()
    release(level)
    return np.frombuffer(found["r"], "<f8").reshape(dim, dim) if found else np.zeros((dim, dim))


def _factors(vectors: DataFrame, rows: object, dim: int) -> DataFrame:
    """A factor for each partition of ``vectors`` (column x) of what ``rows`` makes of a batch of them."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            made = rows(b.column(0))
            for lo in range(0, len(made), BLOCK):
                r = triangle([made[lo : lo + BLOCK]] if r is None else [r, made[lo : lo + BLOCK]])
        if r is not None:
            yield _packed(TaskContext.get().partitionId(), r)

    return vectors.select("x").mapInArrow(own, "node long, r binary")


def _sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each entry, exactly: long sums of a batch, decimal sums of batches."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _entries(b.column(0), dim)
            if len(x):
                yield pa.record_batch([pa.array([len(x)] * dim, pa.int64()), pa.array(range(dim), pa.int32()), pa.array(x.sum(0))], names=["n", "at", "s"])

    parts = vectors.select("x").mapInArrow(own, "n long, at int, s long")
    found = {r["at"]: r for r in parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each entry
    return (int(found[0]["n"]), [int(found[i]["s"]) for i in range(dim)]) if found else (0, [])


def fit(vectors: DataFrame) -> Whitening:
    """The whitening of ``vectors``, a table of usable vectors in column x."""
    dim = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    count, sums = _sums(vectors, dim) if dim else (0, [])
    if not count:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    r = tsqr(_factors(vectors, lambda c: _centred(_entries(c, dim), count, sums), dim), dim)
    _, s, vt = np.linalg.svd(r)
    values = s**2 / count
    some = values > TINY * values[0]
    return Whitening(count, sums, values[some], vt[some].T, float(values.sum()))


def _white(x: np.ndarray, w: Whitening, k: int) -> np.ndarray:
    return _centred(x, w.count, w.sums) @ w.vectors[:, :k] / np.sqrt(w.values[:k])


def identity_error(vectors: DataFrame, w: Whitening, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by R of the whitened rows."""
    k = min(k, len(w.values))
    if not k:
        return 0.0
    dim = len(w.sums)
    r = tsqr(_factors(vectors, lambda c: _white(_entries(c, dim), w, k), k), k)
    return float(np.abs(r.T @ r / w.count - np.eye(k)).max())


def deviations(x: np.ndarray, count: int, sums: list[int]) -> list[int | None]:
    """Of each row the sum of (count * x - sum)^2 over its entries, exactly: None beyond the long range."""
    whole, part = _off(x, count, sums)
    reach = max(int(np.abs(whole).max(initial=0)) * count + int(part.max(initial=0)), 1)
    if reach * reach * max(x.shape[1], 1) < LONG:
        return ((whole * count - part) ** 2).sum(1).tolist()
    exact = ((whole.astype(object) * count - part.astype(object)) ** 2).sum(1).tolist()
    return [v if v < LONG else None for v in exact]


def whiten(vectors: DataFrame, w: Whitening, k: int) -> DataFrame:
    """The rows of ``vectors`` (x and further columns) without x, with deviation and ``whitened``, a list of ``k`` components at most."""
    kept = [f for f in vectors.schema.fields if f.name != "x"]
    types = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kept])
    dim, k = len(w.sums), min(k, len(w.values))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _entries(b.column(0), dim)
            white = _white(x, w, k) if k else np.zeros((len(x), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(white.ravel()))
            columns = [b.column(i + 1).cast(types.field(i).type) for i in range(len(kept))]
            yield pa.record_batch([*columns, pa.array(deviations(x, w.count, w.sums), pa.int64()), lists], names=[*plain, "deviation", "whitened"])

    # Names with a dot don't pass through mapInArrow, so columns go by number there.
    plain = [f"c{i}" for i in range(len(kept))]
    schema = ", ".join([*[f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, kept, strict=True)], "deviation long, whitened array<double>"])
    if not w.count:
        return vectors.drop("x").selectExpr("*", "cast(null as long) as deviation", "cast(array() as array<double>) as whitened").limit(0)
    sent = vectors.select("x", *[F.col(f"`{f.name}`").alias(n) for n, f in zip(plain, kept, strict=True)])
    return sent.mapInArrow(made, schema).toDF(*types.names, "deviation", "whitened")


def whitened(rows: DataFrame, k: int = 32, vec_col: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """For each usable row and component: ``keep``, component (from 1), n, deviation, whitened, explained, identity_error."""
    vectors = rows.where(usable(f"`{vec_col}`")).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    w = fit(vectors)
    error = identity_error(vectors, w, k)
    shares = [float(v / w.trace) for v in w.values[:k]]
    each = whiten(vectors, w, k).select(*[F.col(f"`{c}`") for c in keep], "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("_at") + 1) if shares else F.lit(0.0)
    return each.select(
        *[F.col(f"`{c}`") for c in keep], (F.col("_at") + 1).alias("component"), F.lit(w.count).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
