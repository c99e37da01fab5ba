"""Mixing sources to target weights by weighted fair queueing: DataFrame functions only.

Each source's documents stand in a shuffled order that a hash of their id and a seed fix. A document's
virtual finish time is the number of words of its source up to its own end, divided by what the source is
to get; a source that is to get more than it has is read again, up to ``most`` times in all, and the finish
times go on. Sorted by finish time over all sources, the documents are taken until the next one would
exceed the budget. As all sources reach their targets at the same time, the mix has about the right
shares wherever it is cut.

Sums along an order (the words of a source so far, the words taken so far) are made range by range
(``base.running``), so a source that holds a third of all rows is spread over as many ranges, and no
task sees all rows or a whole source. Only ids, sizes, sources and hashes are shuffled, never texts.

Null texts have no words. Documents without words, and those of sources whose target is zero, are never
taken. A null source is a source of its own, the last one. Repeated rows are documents of their own; null
ids are ids like others. A longer text than a source's target may be left out or, if its turn comes, be
taken whole: documents are never cut. An empty table gives no rows. Further columns are carried along
only if they are named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import release, running, stash

#: A fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source meet its target under so many keys, so that no task has to take a large source alone.
SALTS = 64


@dataclass
class Queue:
    """``docs``: the documents with size, source, source_size, target and ``_sum``, the words of their source up to their own end.

    ``last``: the place of the last document taken, by ``PLACE``, None if none is; ``most``: how often a document may be taken.
    """

    docs: DataFrame
    keep: tuple[str, ...]
    most: int
    last: tuple | None = None


#: The order of the mix. Within a source ``_sum`` tells all documents with words apart.
PLACE = ("_finish", "_none", "_source", "_copy", "_sum")


def words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(id_col: str = "doc_id", seed: int = 13) -> Column:
    """60 bits of a hash of the seed and the id: the place in the shuffled order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """The sources (column source, each once) in code-point order, null last, weighted by ``weights`` again and again: source, weight."""
    ranked = running(sources.select("source"), [F.col("source").isNull(), F.col("source")], {"_rank": F.lit(1)})
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    out = stash(ranked.select("source", each.alias("weight")), "mix-weights")
    release(ranked)
    return out


def targets(sources: DataFrame, budget: int, most: int) -> DataFrame:
    """source, source_size, target for sources with their size and weight.

    Sources share the budget by weight; none gets more than ``most`` times its size, and what is over is
    shared anew among the others. In the order of the share at which a source is full, those before the
    first one that isn't full are: so one sum along that order settles all.
    """
    full = F.col("source_size") * most
    some = sources.where("weight > 0").select("source", "weight", full.alias("_full"))
    along = running(some, [F.col("_full") / F.col("weight"), F.col("source")], {"_fulls": F.col("_full"), "_weights": F.col("weight")})
    total = some.agg(F.sum("weight")).first()[0] or 0.0
    share = (budget - (F.col("_fulls") - F.col("_full"))) / (total - (F.col("_weights") - F.col("weight")))
    first = along.where(share * F.col("weight") <= F.col("_full")).agg(F.max(share)).first()[0]
    release(along)
    aim = full.cast("double") if first is None else F.least(full.cast("double"), F.lit(first) * F.col("weight"))
    return sources.select("source", "source_size", F.when(F.col("weight") > 0, aim).otherwise(0.0).alias("target"))


def fair_queue(
    docs: DataFrame, weights: DataFrame | tuple[float, ...], share: float = 1.0, most: int = 3, seed: int = 13,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> Queue:
    """The queue of all documents, and where the mix of ``share`` of all words ends in it.

    ``weights``: source, weight, a row for each source (those that it lacks get nothing), or numbers that
    the sources in code-point order have in turn, again and again.
    """
    sized = stash(
        docs.select(*[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate((id_col, *keep))], F.col(f"`{source_col}`").alias("source"),
                    words(text_col).alias("size"), shuffle_key(id_col, seed).alias("_hash")),
        "mix-sizes",
    )
    same = F.col("source").eqNullSafe(F.col("_other"))
    sources = stash(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    budget = int((sources.agg(F.sum("source_size")).first()[0] or 0) * share)
    own = isinstance(weights, tuple)
    weighed = cycled_weights(sources, weights) if own else weights
    known = sources.join(weighed.select(F.col("source").alias("_other"), F.col("weight").cast("double")), same, "left")
    aims = targets(known.select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")), budget, most)
    in_order = [F.col("source").isNull(), F.col("source")]
    starts = running(aims, in_order, {"_ends": F.col("source_size")})
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    aims = starts.select(F.col("source").alias("_other"), "source_size", "target", (F.col("_ends") - F.col("source_size")).alias("_start"), salts)
    along = running(sized, [*in_order, F.col("_hash"), F.col("_keep_0"), F.col("size")], {"_sum": F.col("size")})
    met = along.join(aims, same & (F.col("_hash") % SALTS == F.col("_salt"))).withColumn("_sum", F.col("_sum") - F.col("_start"))
    queue = stash(met.select(*[c for c in sized.columns if c != "_hash"], "source_size", "target", "_sum"), "mix-queue")
    release(sized, sources, along, starts, *([weighed] if own else []))
    found = Queue(queue, (id_col, *keep), most)
    copies = running(_copies(found).select(*PLACE, "size"), [F.col(c) for c in PLACE], {"_taken": F.col("size")})
    ends = copies.where(F.col("_taken") <= budget).orderBy(*[F.desc(c) for c in PLACE]).select(*PLACE).first()  # one row
    found.last = tuple(ends) if ends else None
    release(copies)
    return found


def _place(copy: Column) -> list[Column]:
    finish = (copy * F.col("source_size") + F.col("_sum")) / F.nullif(F.col("target"), F.lit(0.0))
    each = (finish, F.col("source").isNull(), F.coalesce("source", F.lit("")), copy, F.col("_sum"))
    return [c.alias(n) for n, c in zip(PLACE, each, strict=True)]


def _copies(queue: Queue) -> DataFrame:
    """A row for each time that a document may be taken, with its place; the first time is copy 0."""
    some = queue.docs.where("size > 0 and target > 0").withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(queue.most - 1))))
    return some.select(*_named(queue), "size", *_place(F.col("_of")))


def _within(queue: Queue, place: list[Column]) -> Column:
    if queue.last is None:
        return F.lit(False)
    end = [F.lit(v).cast(t).alias(n) for n, t, v in zip(PLACE, ("double", "boolean", "string", "int", "long"), queue.last, strict=True)]
    return F.struct(*place) <= F.struct(*end)


def _named(queue: Queue) -> list[Column]:
    return [F.col(f"_keep_{i}").alias(c) for i, c in enumerate(queue.keep)]


def mixed(queue: Queue) -> DataFrame:
    """The id and kept columns, size, source_size, target, and taken (the words that the mix takes, repeats counted) of each document."""
    times = sum((_within(queue, _place(F.lit(n))).cast("int") for n in range(queue.most)), F.lit(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), times * F.col("size")).otherwise(F.lit(0))
    return queue.docs.select(*_named(queue), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixture(queue: Queue) -> DataFrame:
    """A row for each time that a document is taken, in the order of the mix: the id and kept columns, size, copy (from 0), finish."""
    rows = _copies(queue)
    rows = rows.where(_within(queue, [F.col(c) for c in PLACE])).orderBy(*PLACE)
    return rows.select(*[F.col(f"`{c}`") for c in queue.keep], "size", F.col("_copy").alias("copy"), F.col("_finish").alias("finish"))
