"""A level of the search by columns, for dense data: lists by item stand beside each other, and all ways to grow an itemset are one product of arrays.

A task takes blocks of transactions. A block has a column for each item: probabilities (zero where the item
isn't there), utilities and what comes after. An itemset's own list is the product and sum of its items'
columns; joined with the columns of all later items at once it gives their sums over the block, which
Spark adds up by itemset. Itemsets go through a block in classes of ``CLASS`` with their columns, so what a task
holds is bounded by the block and the class, whatever the number of transactions or itemsets.

Growing within rows makes a row for each occurrence; this makes a cell for each transaction, itemset and later
item, present or not. It pays where most are present (``pays``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that columns are made of, cells of a block's column set, and itemsets of a class.
MOST_ITEMS, BLOCK_CELLS, CLASS = 4096, 1 << 20, 128
#: What an occurrence within a row costs, in cells.
ROW_COST = 6


def pays(transactions: int, itemsets: int, occurrences: int, items: int, length: float) -> bool:
    """Whether columns cost less: cells of all itemsets against the rows that their occurrences grow into."""
    return items <= MOST_ITEMS and transactions * itemsets * items < ROW_COST * occurrences * length


def _columns(batch: pa.RecordBatch, place: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p, u, rem of a batch of transactions, a column for each item."""
    lists = [batch.column(i) for i in range(4)]
    lengths = np.diff(lists[0].offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), lengths)
    column = np.array([place[i] for i in lists[0].flatten().to_numpy().tolist()], np.int64)
    out = np.zeros((3, batch.num_rows, len(place)))
    for layer, values in zip(out, lists[1:], strict=True):
        layer[row, column] = values.flatten().to_numpy()
    return out[0], out[1], out[2]


def _sums(p: np.ndarray, u: np.ndarray, rem: np.ndarray, sets: list[list[int]], able: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each itemset (places, ascending): its number, the later places it grows by in this block, and there eu, log of missing, ub and count."""
    there = p > 0
    for n, places in enumerate(sets):
        own = there[:, places].all(1)
        later = able[able > places[-1]]
        if not own.any() or not len(later):
            continue
        mine, plus = p[own][:, places].prod(1), u[own][:, places].sum(1)
        q = mine[:, None] * p[own][:, later]
        worth = plus[:, None] + u[own][:, later]
        count = (q > 0).sum(0)
        met = np.flatnonzero(count)
        q, worth = q[:, met], worth[:, met]
        with np.errstate(divide="ignore"):
            missing = np.log1p(-q).sum(0)
        bound = (np.maximum(worth + rem[own][:, later[met]], 0.0) * q).sum(0)
        yield n, later[met], np.stack([(worth * q).sum(0), missing, bound, count[met].astype(float)])


def measured(tails: DataFrame, sets: list[list[int]], items: list[tuple[int, float]], reach: float) -> DataFrame:
    """items, eu, ep, ub, n of all itemsets that grow from ``sets`` by a later item whose bound reaches ``reach``.

    ``items``: all items with their bounds, in rank order; ``sets``: itemsets in rank order, few enough to be sent to all tasks.
    """
    order = [i for i, _ in items]
    place = {i: n for n, i in enumerate(order)}
    able = np.array([n for n, (_, b) in enumerate(items) if b >= reach], np.int64)
    placed = [[place[i] for i in x] for x in sets]
    rows = max(BLOCK_CELLS // max(len(items), 1), 16)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                columns = _columns(b.slice(lo, rows), place)
                for first in range(0, len(placed), CLASS):
                    found = list(_sums(*columns, placed[first : first + CLASS], able))
                    if found:
                        size = [len(at) for _, at, _ in found]
                        sums = np.concatenate([x for _, _, x in found], axis=1)
                        of = np.repeat([first + n for n, _, _ in found], size)
                        at = np.concatenate([at for _, at, _ in found])
                        yield pa.record_batch([pa.array(of, pa.int32()), pa.array(at, pa.int32()), *map(pa.array, sums)], names=["of", "at", "eu", "missing", "ub", "n"])

    parts = tails.select("t_item", "t_p", "t_u", "t_rem").mapInArrow(own, "of int, at int, eu double, missing double, ub double, n double")
    total = parts.groupBy("of", "at").agg(F.sum("eu").alias("eu"), (-F.expm1(F.sum("missing"))).alias("ep"), F.sum("ub").alias("ub"), F.sum("n").cast("long").alias("n"))
    known = tails.sparkSession.createDataFrame([(n, x) for n, x in enumerate(sets)], "of int, prefix array<int>")
    named = tails.sparkSession.createDataFrame(list(enumerate(order)), "at int, item int")
    met = total.join(F.broadcast(known), "of").join(F.broadcast(named), "at")
    return met.select(F.concat("prefix", F.array("item")).alias("items"), "eu", "ep", "ub", "n", F.lit(None).cast("double").alias("pair"))
