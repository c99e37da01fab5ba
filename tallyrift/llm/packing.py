"""Best-fit packing by exact complements: lengths that together fill a sequence are used up first.

Only the counts of lengths, of which there are at most ``capacity``, reach the driver. The plan made
from them says which lengths share sequences, how many times; each piece then finds its place from
its rank among the pieces of its length. Ranks come from counts by (bucket, length), so a length
that a third of all pieces have is numbered in as many tasks as any other.

Null texts count as empty and hold the end token only. Repeated rows are documents of their own; very
long texts are cut into pieces as they come. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stash
from .tokens import encoder

#: Pieces that are placed by one task.
BUCKET_ROWS = 100_000


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, _number (another for each row) and, if wanted, ids: the whole documents, cut at ``capacity``."""
    kind = next(t for n, t in docs.dtypes if n == id_col)
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _number bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, enc = np.array([end_id], "<u4").tobytes(), encoder(tokenizer)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, size, crc, ids = [], [], [], [], [], []
                for i, b in enumerate(enc.encode(part.column(1).to_pylist())):
                    b += end
                    for k in range(0, len(b), 4 * capacity):
                        own = b[k : k + 4 * capacity]
                        row.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        size.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                numbers = np.arange(number, number + len(row))
                number += len(row)
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc, numbers))]
                names = [id_col, "piece", "start", "length", "ids_crc32", "_number"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(cut, schema)


class Sums:
    """Which gaps one, two or three available lengths fill exactly: an index by sum, of the lengths that are left.

    ``pairs`` and ``triples`` hold for each sum a way that was there when last looked for, or none; lengths only get fewer,
    so a sum without a way has none later on, and a way is looked for again only when its lengths have run out.
    """

    def __init__(self, have: np.ndarray):
        there = np.flatnonzero(have)
        self.size = len(have)
        self.maybe_pair, self.maybe_triple = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for a in there:
            s = there + a
            self.maybe_pair[s[s < self.size]] = True
        for a in there:
            s = np.flatnonzero(self.maybe_pair[: self.size - a]) + a
            self.maybe_triple[s] = True
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    @staticmethod
    def _left(have: np.ndarray, lengths: list[int]) -> bool:
        return all(have[x] >= lengths.count(x) for x in lengths)

    def pair(self, have: np.ndarray, gap: int) -> list[int] | None:
        """Two lengths that add up to ``gap``, the larger as large as can be."""
        if gap < 2 or not self.maybe_pair[gap]:
            return None
        way = self.pairs.get(gap)
        if way is None or not self._left(have, way):
            large = np.arange(gap - 1, (gap - 1) // 2, -1)
            ok = (have[large] > 0) & (have[gap - large] > (large == gap - large))
            if not ok.any():
                return None
            b = int(large[ok.argmax()])
            way = self.pairs[gap] = [b, gap - b]
        return way

    def triple(self, have: np.ndarray, gap: int) -> list[int] | None:
        """Three lengths that add up to ``gap``, the first as large as can be when it was looked for."""
        if gap < 3 or not self.maybe_triple[gap]:
            return None
        way = self.triples.get(gap)
        if way is not None and self._left(have, way):
            return way
        firsts = np.flatnonzero(have[:gap])[::-1]
        for b in firsts[self.maybe_pair[gap - firsts]].tolist():
            have[b] -= 1
            rest = self.pair(have, gap - b)
            have[b] += 1
            if rest:
                self.triples[gap] = [b, *rest]
                return self.triples[gap]
        return None

    def fill(self, have: np.ndarray, gap: int) -> list[int] | None:
        """One, two or three available lengths that fill ``gap`` exactly."""
        if have[gap] > 0:
            return [gap]
        return self.pair(have, gap) or self.triple(have, gap)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences), for every length as often as it is there.

    The longest length left opens a sequence. If one, two or three others fill its gap exactly, they
    do; else the longest that fits goes in (best fit) and the rest of the gap is tried again. The same
    sequence is made as often as its lengths allow, so each step uses one of them up, or nearly.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    sums = Sums(have)
    out = []
    for a in range(capacity, 0, -1):
        while have[a] > 0:
            row, left = [a], have.copy()
            left[a] -= 1
            gap = capacity - a
            while gap > 0:
                if more := sums.fill(left, gap):
                    row += more
                    break
                fit = np.flatnonzero(left[1 : gap + 1])
                if not len(fit):
                    break
                b = int(fit[-1]) + 1
                row.append(b)
                left[b] -= 1
                gap -= b
            kinds, uses = np.unique(row, return_counts=True)
            times = int((have[kinds] // uses).min())
            have[kinds] -= uses * times
            out.append((row, times))
    return out


def slots(made: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: where each rank of a length goes."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for lengths, times in made:
        at = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), first, at))
            used[length] = used.get(length, 0) + times
            at += length
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset: gapless, in as few sequences as this finds."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    # By the number that each piece was written with, so that repeated rows are dealt apart.
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("_number"), F.lit(buckets)).cast("int"))
    by_bucket = dealt.groupBy("_bucket", "length").count()
    # Columns of their own: a cogroup's sides may not share any.
    before = by_bucket.select(
        F.col("_bucket").alias("_in"), F.col("length").alias("_of"),
        (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"),
    )

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left, sort_keys=[("length", "ascending"), ("_number", "ascending")]))
        base = np.zeros(capacity + 1, np.int64)
        base[right.column("_of").to_numpy()] = right.column("_before").to_numpy()
        length = left.column("length").to_numpy()
        rank = np.arange(len(length)) - np.searchsorted(length, length) + base[length]
        t = table.value
        big = np.int64(1) << 44
        found = t[np.searchsorted(t[:, 0] * big + t[:, 1], length * big + rank, "right") - 1]
        return pa.table({"_number": left.column("_number"), "sequence_id": pa.array(found[:, 2] + rank - found[:, 1], pa.int64()), "offset": pa.array(found[:, 3], pa.int64())})

    # Only numbers and lengths go through Python again; ids stay with Spark.
    small = dealt.select("_bucket", "_number", "length")
    placed = small.groupBy("_bucket").cogroup(before.groupBy("_in")).applyInArrow(place, "_number bigint, sequence_id bigint, offset bigint")
    return cut.join(placed, "_number").drop("_number")
