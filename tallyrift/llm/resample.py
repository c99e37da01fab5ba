"""Importance resampling towards a target: documents are drawn by how much likelier their words are in the target's texts.

Features are words and pairs of neighbouring words, counted in ``buckets`` buckets of a checksum, over all documents
and over all target texts. A bucket's gain is the floored logarithm of how much more of the target it has; a
document's weight is the mean gain of its features, looked up in an array of all gains. Noise of a
Gumbel distribution, fixed by a hash of the id, is added: the highest scores are then a draw without replacement
by weight.

The draw merges runs. Each partition sorts its eligible documents and writes them as a run. Splitters that Spark
draws from the runs cut the order of scores into ranges of about ``RANGE_ROWS`` documents; a range has a
slice of each run. Ranges are counted, so each knows the ranks that it gives. Those that end behind the draw
aren't merged at all; of the others, a tournament tree plays the first of each slice against each other, and
stops when the exact number is drawn. A task holds one range, and none holds a whole run or the whole order.

Null texts have no words, and weigh 0. Documents of fewer than ``least_words`` words are not eligible. Ties go to
the smaller id, null ids last; repeated rows are drawn as rows of their own, each with a rank of its own. Without
target texts or documents all counts are zero, and so all gains. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .base import partitions, release, stash

#: Bytes of text that are cut into words at once; longest word whose checksum is made beside others', byte by byte.
PIECE, LONGEST = 4 << 20, 64
RANGE_ROWS = 1 << 18
BYTES = np.arange(256)
#: A-Z become a-z; words are made of 0-9, a-z and all that isn't ASCII.
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
IN_WORD = ((BYTES >= 48) & (BYTES <= 57)) | ((BYTES >= 97) & (BYTES <= 122)) | (BYTES >= 128)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum's step for each byte, and for 0 to LONGEST zero bytes what each byte of a checksum becomes behind them."""
    step = BYTES.astype(np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    behind = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    for i in range(4):
        behind[0, i] = (BYTES << (8 * i)).astype(np.uint32)
    for n in range(LONGEST):
        behind[n + 1] = step[behind[n] & 255] ^ (behind[n] >> 8)
    return step, behind


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 of each word, and of each pair of a word and the one before it, joined by a blank (that of the first word says nothing)."""
    step, behind = _tables()
    lengths = ends - starts
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(lengths <= LONGEST)
    place = 0
    while len(at):
        now = state[at]
        state[at] = step[(now ^ data[starts[at] + place]) & 255] ^ (now >> 8)
        place += 1
        at = at[lengths[at] > place]
    for i in np.flatnonzero(lengths > LONGEST):
        state[i] = zlib.crc32(data[starts[i] : ends[i]]) ^ 0xFFFFFFFF
    own = ~state
    # A pair's checksum is that of the word before and the blank, moved on by this word's length, and this word's.
    left = ~(step[(state ^ 32) & 255] ^ (state >> 8))
    left = np.append(np.uint32(0), left[:-1]).astype(np.uint32)
    short = np.minimum(lengths, LONGEST)
    moved = behind[short, 0, left & 255] ^ behind[short, 1, (left >> 8) & 255] ^ behind[short, 2, (left >> 16) & 255] ^ behind[short, 3, left >> 24]
    pair = moved ^ own
    for i in np.flatnonzero(lengths > LONGEST):
        if i:
            pair[i] = zlib.crc32(data[starts[i] : ends[i]], zlib.crc32(b" ", int(own[i - 1])))
    return own, pair


def _pieces(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Texts (first, last) in pieces of about PIECE bytes (from, to): several texts, or a part of a long one that ends behind a word."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1
        if last > first:
            yield first, last, int(offsets[first]), int(offsets[last])
            first = last
            continue
        lo, end = int(offsets[first]), int(offsets[first + 1])
        while lo < end:
            hi = min(lo + PIECE, end)
            while hi < end and IN_WORD[LOWER[data[hi]]]:
                hi += 1
            yield first, first + 1, lo, hi
            lo = hi
        first += 1


def features(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The features of a batch of texts piece by piece: the text of each word, the word's bucket, and the bucket of it and the word before (-1: none)."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        return
    data = np.frombuffer(column.buffers()[2], np.uint8)
    before: tuple[int, bytes] | None = None
    for first, last, lo, hi in _pieces(offsets, data):
        # A long text's piece begins with the last word of the piece before.
        head = before[1] + b" " if before and before[0] == first else b""
        piece = LOWER[np.concatenate([np.frombuffer(head, np.uint8), data[lo:hi]])] if head else LOWER[data[lo:hi]]
        inside = np.append(IN_WORD[piece], False)
        cuts = np.maximum(offsets[first : last + 1] - lo, 0) + len(head)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.append(0, edge)
        starts, ends = edge[::2], edge[1::2]
        # Texts that meet without a sign between are cut apart.
        inner = cuts[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(piece))])
        joined = inner[inside[inner - 1] & inside[inner]]
        if len(joined):
            starts, ends = np.sort(np.append(starts, joined)), np.sort(np.append(ends, joined))
        if not len(starts):
            continue
        text = np.searchsorted(cuts[1:], starts, "right") + first
        text = np.minimum(text, last - 1)
        word, pair = _checksums(piece, starts, ends)
        word, pair = (word % buckets).astype(np.int64), (pair % buckets).astype(np.int64)
        pair[np.append(True, text[1:] != text[:-1])] = -1
        before = (last - 1, piece[starts[-1] : ends[-1]].tobytes())
        skip = 1 if head else 0
        yield text[skip:], word[skip:], pair[skip:]


def counts(texts: DataFrame, buckets: int, text_col: str = "text") -> list[int]:
    """How many features each bucket has: each partition counts its own, ``buckets`` rows are left at the end."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets + 1, np.int64)
        for b in batches:
            for _, word, pair in features(b.column(0), buckets):
                n += np.bincount(word, minlength=buckets + 1)
                n += np.bincount(pair + 1, minlength=buckets + 1)[np.append(np.arange(1, buckets + 1), 0)]
        at = np.flatnonzero(n[:buckets])
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(n[at])], names=["b", "n"])

    parts = texts.select(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).mapInArrow(own, "b int, n long")
    found = {r[0]: r[1] for r in parts.groupBy("b").agg(F.sum("n")).collect()}
    return [found.get(b, 0) for b in range(buckets)]


def gains(raw: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket."""
    up, down, n = float(sum(raw) + len(raw)), float(sum(target) + len(raw)), range(len(raw))
    return [math.floor(1000 * math.log((target[b] + 1.0) * up / ((raw[b] + 1.0) * down))) for b in n]


def gumbel(id_col: str, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], seed: int, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep``, n_words, n_features, weight, score of each document; the first of ``keep`` is the id."""
    kept = [docs.schema[c] for c in keep]
    types = [to_arrow_type(f.dataType) for f in kept]
    table = np.array([*gain, 0], np.int64)  # the last for words that have none before

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, pairs, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for text, word, pair in features(b.column(0), len(gain)):
                lo, size = text[0], text[-1] - text[0] + 1
                at = slice(lo, lo + size)
                n[at] += np.bincount(text - lo, minlength=size)
                pairs[at] += np.bincount(text[pair >= 0] - lo, minlength=size)
                starts = np.flatnonzero(np.diff(text, prepend=-1))
                total[text[starts]] += np.add.reduceat(table[word] + table[pair], starts)
            found = n + pairs
            weight = np.floor_divide(total, np.maximum(found, 1))
            columns = [b.column(i + 1).cast(t) for i, t in enumerate(types)]
            yield pa.record_batch([*columns, pa.array(n), pa.array(found), pa.array(weight)], names=[*plain, "n_words", "n_features", "weight"])

    # Names with a dot don't pass through mapInArrow, so columns go by number there.
    plain = [f"c{i}" for i in range(len(keep))]
    schema = ", ".join([*[f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, kept, strict=True)], "n_words long, n_features long, weight long"])
    sent = [F.col(f"`{c}`").alias(n) for n, c in zip(plain, keep, strict=True)]
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *sent).mapInArrow(own, schema).toDF(*keep, "n_words", "n_features", "weight")
    return rows.withColumn("score", (F.col("weight") + gumbel(keep[0], seed)).cast("long"))


class Tournament:
    """A tree of matches between the first keys of sorted slices: each inner node holds the loser of its match, ``winner`` the slice that won them all."""

    def __init__(self, keys: list[tuple]):
        self.size, self.keys = max(len(keys), 1), list(keys)
        self.losers = [0] * self.size
        won = [0] * (2 * self.size)
        for leaf in range(self.size):
            won[self.size + leaf] = leaf
        for node in range(self.size - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self.keys[a] <= self.keys[b] else (b, a)
        self.winner = won[1] if self.size > 1 else 0

    def replace(self, key: tuple) -> None:
        """The winner's slice goes on to ``key``: only the matches on its way up are played again."""
        at = self.winner
        self.keys[at] = key
        node = (self.size + at) // 2
        while node:
            other = self.losers[node]
            if self.keys[other] < self.keys[at]:
                self.losers[node], at = at, other
            node //= 2
        self.winner = at


#: The key of a slice that is used up: behind all others.
NONE_LEFT = (2, 0, 0)


def merge(slices: list[tuple[np.ndarray, list[tuple]]], count: int) -> list[int]:
    """The rows of the first ``count`` keys of sorted slices (row numbers, keys), in order."""
    out, at = [], [0] * len(slices)
    tree = Tournament([keys[0] if keys else NONE_LEFT for _, keys in slices])
    while len(out) < count:
        i = tree.winner
        rows, keys = slices[i]
        out.append(int(rows[at[i]]))
        at[i] += 1
        tree.replace(keys[at[i]] if at[i] < len(keys) else NONE_LEFT)
    return out


def drawn(rows: DataFrame, share: int, eligible: Column, order: tuple[str, str] = ("score", "doc_id")) -> DataFrame:
    """``rows`` with rank: from 1 by falling ``order[0]``, then ``order[1]`` (a number), for ``share`` hundredths of the eligible ones; null for all others."""
    spark, given = rows.sparkSession, rows.columns
    # Names with a dot don't pass through applyInArrow, so columns go by number there.
    rows = rows.withColumn("_may", F.coalesce(eligible, F.lit(False))).toDF(*[f"c{i}" for i in range(len(given))], "_may")
    order = tuple(f"c{given.index(c)}" for c in order)
    score, ident = (F.col(c) for c in order)
    by = [score.desc(), ident.asc_nulls_last()]
    own = rows.withColumn("_run", F.spark_partition_id())
    rows = rows.drop("_may")
    cols = [F.col(c) for c in rows.columns]
    runs = stash(own.sortWithinPartitions(F.col("_may").desc(), *by).withColumn("_place", F.monotonically_increasing_id()), "runs")
    able = runs.where("_may")
    total = able.count()
    count = share * total // 100
    parts = max(min(partitions(spark), total), -(-total // RANGE_ROWS), 1)
    ranges = stash(able.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()), "run-slices")
    # A row for each range: as many as there are tasks.
    before, take = 0, []
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():
        take.append((r[0], before, max(0, min(r[1], count - before))))
        before += r[1]
    plan = spark.createDataFrame(take, "_range int, _before long, _take long")
    names, ident_name, score_name = rows.columns, order[1], order[0]
    types = pa.schema([*[(f.name, to_arrow_type(f.dataType)) for f in rows.schema.fields], ("rank", pa.int64())])

    def merged(group: pa.Table) -> pa.Table:
        run, place = group["_run"].to_numpy(), group["_place"].to_numpy()
        by_slice = np.lexsort((place, run))
        starts = np.append(np.flatnonzero(np.diff(run[by_slice], prepend=-1)), len(run))
        falling, ids = (-group[score_name].to_numpy()).tolist(), group[ident_name].to_pylist()
        slices = []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            at = by_slice[lo:hi]
            slices.append((at, [(0, falling[i], ids[i]) if ids[i] is not None else (0, falling[i], float("inf")) for i in at.tolist()]))
        got = merge(slices, group["_take"][0].as_py())
        rank = np.zeros(len(run), np.int64)
        rank[got] = np.arange(len(got)) + 1 + group["_before"][0].as_py()
        out = pa.table({n: group[n] for n in names}).append_column("rank", pa.array(rank, mask=rank == 0))
        return out.cast(types)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", rank long"
    met = ranges.join(F.broadcast(plan), "_range")
    none = F.lit(None).cast("long").alias("rank")
    first = met.where("_take > 0").groupBy("_range").applyInArrow(merged, schema)
    rest = met.where("_take = 0").select(*cols, none)
    return first.unionByName(rest).unionByName(runs.where("not _may").select(*cols, none)).toDF(*given, "rank")


def resample(
    docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000,
    keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """``keep``, n_words, n_features, weight, score, rank of each document; rank is null where it isn't drawn.

    ``share`` hundredths of the documents of ``least_words`` or more are drawn. ``keep``: the id, a number, and narrow columns to carry along.
    """
    gain = gains(counts(docs, buckets, text_col), counts(target, buckets, target_col))
    return drawn(scored(docs, gain, seed, keep, text_col), share, F.col("n_words") >= least_words, ("score", keep[0]))
