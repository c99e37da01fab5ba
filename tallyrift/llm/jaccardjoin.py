"""N-gram Jaccard join: a MinHash LSH forest proposes, exact verification decides.

Each trie has the documents by a path of ``longest`` values of their MinHash signature. A node of a trie
is a prefix of a path, from ``shortest`` values on; its group are the documents whose paths go through
it. How short a document's prefixes become depends on what they match: ``scouts`` tries of their own
tell how many others share its prefixes, and from the longest on they are shortened as long as those
are no more than ``crowd``. A prefix of that length is then looked up in as many of the other tries as
it takes for a neighbour at the threshold to share one of them with the target recall: long prefixes
in many tries where many documents are alike, short ones in fewer tries where few are. As the scouts'
values are independent of the others', what they match doesn't bias that recall, and it holds for each
document on its own, whatever the others' prefixes are.

Documents with the same set of shingles are one class, found and verified once, however many copies
there are. Groups are tied to their smallest class, not paired; the tied sets are brought together
with their shingles, and all pairs in a set are verified exactly. A set of many classes is cut into
slices, and each pair of slices is one task. What a task yields is a count for each class and a forest
of its links, so nothing grows with the number of pairs. Only texts that are tied are moved.

Null, empty and blank texts have no words: they link with nothing. Texts shorter than a shingle have
one shingle of all their words; very long ones are read whole. Rows that repeat, also with the same
id, are documents of their own and copies of each other. An empty table gives no rows. Only the
columns named are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import partitions, release, stash
from .components import components
from .shingles import multipliers, shingle_set, signature
from .vectordup import union

#: Classes and bytes that one slice of a tied set holds.
SLICE_ROWS, SLICE_BYTES = 1500, 12 << 20
#: Bits of the filter of tied texts, at most: 32 MB reach the driver and the workers.
FILTER_BITS = 28
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def roots(paths: np.ndarray, shortest: int) -> np.ndarray:
    """Of paths (..., trees, values) the number of each tree's node at the shortest prefix."""
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, paths.shape[-2] + 1, dtype=np.uint64) * ODD, paths.shape[:-1])
        for d in range(shortest):
            h = _mixed(h + paths[..., d].astype(np.uint64) * ODD)
    return h


def nodes(root: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The numbers of the nodes (..., depths) from the root on, one value further each."""
    out = [root]
    with np.errstate(over="ignore"):
        for d in range(tails.shape[-1]):
            out.append(_mixed(out[-1] + (tails[..., d].astype(np.uint64) + np.uint64(1)) * ODD))
    return np.stack(out, -1)


def trees_for(length: int, least: float, recall: float) -> int:
    """In how many tries a pair of similarity ``least`` shares a prefix of that length at least once with ``recall``."""
    return math.ceil(math.log1p(-recall) / math.log1p(-(least**length)) - 1e-9)


def prefix_lengths(matched: np.ndarray, shortest: int, crowd: int) -> np.ndarray:
    """The length of each document's prefixes; ``matched``: of (document, length) how many others its scouts found."""
    few = matched <= crowd
    return np.where(few.any(1), few.argmax(1), matched.shape[1] - 1) + shortest


def similar_pairs(sets: list[np.ndarray], least: float, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of ``sets`` with a Jaccard similarity of at least ``least``; with ``split``, only i < split <= j."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    every, where = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(n), sizes)
    shared = np.bincount(where, minlength=len(every)) > 1
    place = np.cumsum(shared) - 1
    on = shared[where]
    wide = int(shared.sum())
    rows, cols = rows[on], place[where[on]]
    first, second = [], []
    if wide == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.zeros((n, -(-wide // 64)), np.uint64)
    np.bitwise_or.at(bits, (rows, cols // 64), np.uint64(1) << (cols % 64).astype(np.uint64))
    order = np.argsort(sizes, kind="stable")  # similar sets have similar sizes
    sized = sizes[order]
    step = max(1, (32 << 20) // (8 * bits.shape[1]))  # so many rows are compared at once
    for at in range(n):
        i = order[at]
        last = np.searchsorted(sized, sizes[i] / least + 1e-9, "right")
        for k in range(at + 1, last, step):
            js = order[k : min(last, k + step)]
            if split:
                js = js[(js < split) != (i < split)]
            both = np.bitwise_count(bits[js] & bits[i]).sum(1, dtype=np.int64)
            js = js[both >= least * (sizes[js] + sizes[i] - both) - 1e-9]
            first.append(np.minimum(js, i))
            second.append(np.maximum(js, i))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def forest_ties(classes: DataFrame, least: float, shortest: int, longest: int, recall: float, scouts: int, crowd: int) -> DataFrame:
    """a, b: each class and the smallest one of the group of each prefix that it has and some class looks up.

    The last ``scouts`` of a class's tries are the scouts.
    """
    needed = np.array([trees_for(d, least, recall) for d in range(shortest, longest + 1)])
    trees = int(needed.max()) + scouts
    wide = longest - shortest
    each = classes.select("cls", F.posexplode("roots").alias("tree", "root"))
    shared = stash(each.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "roots")
    # Classes that match another one at all, and in which trees.
    some = each.join(shared, "root").groupBy("cls").agg(F.collect_list("tree").alias("in"))
    matched = stash(classes.select("cls", "roots", "tails").join(some, "cls"), "matched")

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each node of a class below its shared roots."""
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n = batch.num_rows
                root = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, trees)
                tails = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(n, trees, wide)
                tree = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(n), batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
                found = nodes(root[row, tree], tails[row, tree])
                cls = batch.column(0).to_numpy()[row]
                deep = np.tile(np.arange(wide + 1), len(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(cls, wide + 1)), pa.array((np.repeat(tree, wide + 1) * (wide + 1) + deep).astype(np.int32)), pa.array(found.ravel().view(np.int64))],
                    ["cls", "spot", "node"],
                )

    paths = matched.select("cls", "roots", "tails", "in").mapInArrow(through, "cls bigint, spot int, node bigint")
    groups = stash(paths.groupBy("node").agg(F.count("*").alias("n"), F.min("cls").alias("hub")).where("n > 1"), "groups")
    # At most a row for each tree and length; nodes that only one class has match none.
    passed = paths.join(groups, "node").groupBy("cls").agg(F.collect_list(F.struct("spot", "n", "node", "hub")).alias("at"))
    passed = stash(passed, "passed")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes at the ends of the prefixes chosen."""
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n = batch.num_rows
                rows = np.repeat(np.arange(n), batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
                spots, many, node = (batch.column(0).flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
                tree, deep = np.divmod(spots, wide + 1)
                scout = tree >= trees - scouts
                others = np.zeros((n, wide + 1), np.int64)
                np.add.at(others, (rows[scout], deep[scout]), many[scout] - 1)
                deepest = prefix_lengths(others, shortest, crowd) - shortest
                asks = (deep == deepest[rows]) & (tree < needed[deepest[rows]])
                yield pa.RecordBatch.from_arrays([pa.array(node[asks])], ["node"])

    asked = passed.select("at").mapInArrow(choose, "node bigint").distinct()
    ties = passed.select("cls", F.explode("at").alias("x")).select("cls", "x.node", "x.hub").where("cls <> hub").join(asked, "node", "left_semi")
    ties = stash(ties.select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct(), "ties")
    release(shared, matched, groups, passed)
    return ties


def filter_size(count: int) -> int:
    """Bits, as a power of two, of a filter of so many keys."""
    return min(FILTER_BITS, max(16, (16 * count).bit_length()))


def _place(key: Column, bits: int) -> Column:
    """A key's place in a filter; bitmaps count from 1."""
    return F.shiftright(F.conv(F.substring(key, 1, 7), 16, 10).cast("long"), 28 - bits) + 1


def bitmaps(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """k, bits: the filter of the keys, cut into bitmaps of 4096 bytes."""
    at = keys.select(_place(F.col(key), bits).alias("at"))
    return at.groupBy(F.expr("bitmap_bucket_number(at)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))


def with_mark(docs: DataFrame, text_col: str, keys: DataFrame, key: str, name: str) -> DataFrame:
    """``docs`` and whether the filter of ``keys`` has their text's key: true for all that are among them, and for few others.

    The filter is of a fixed size at most, so it is broadcast and no text is moved.
    """
    bits = filter_size(keys.count())
    maps = bitmaps(keys, key, bits).withColumnsRenamed({"k": "__mark_of", "bits": "__mark_bits"})
    rows = docs.withColumn("__mark_at", _place(_key(F.col(f"`{text_col}`")), bits))
    rows = rows.join(F.broadcast(maps), F.expr("bitmap_bucket_number(__mark_at) = __mark_of"), "left")
    byte = F.expr("int(conv(hex(substring(__mark_bits, int(bitmap_bit_position(__mark_at) div 8) + 1, 1)), 16, 10))")
    found = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, int(bitmap_bit_position(__mark_at) % 8))")) != 0, F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], found.alias(name))


def tied_sets(docs: DataFrame, text_col: str, members: DataFrame, words: int) -> DataFrame:
    """tie, cls, weight, shingles of ``members`` (tie, cls, weight, text_key), read from the texts of ``docs``.

    A filter of fixed size keeps most texts that aren't tied from being moved; the join decides.
    """
    spark = docs.sparkSession
    bits = filter_size(members.count())
    marks = bitmaps(members, "text_key", bits)
    filled = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for k, own in marks.collect():  # one bit for each place of the filter: a fixed size
        filled[(k - 1) * 4096 : (k - 1) * 4096 + len(own)] = np.frombuffer(bytes(own), np.uint8)
    held = spark.sparkContext.broadcast(filled)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, met = held.value, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                keys, texts = whole.column(0).slice(at, 256).to_pylist(), whole.column(1).slice(at, 256)
                want = []
                for i, key in enumerate(keys):
                    spot = int(key[:7], 16) >> (28 - bits)
                    if marked[spot >> 3] >> (spot & 7) & 1 and key not in met:
                        met.add(key)
                        want.append(i)
                sets = [shingle_set(texts[i].as_py(), words).tobytes() for i in want]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in want], pa.string()), pa.array(sets, pa.binary())], ["text_key", "shingles"])

    text = F.col(f"`{text_col}`")
    seen = docs.select(_key(text).alias("text_key"), text.alias("text")).mapInArrow(read, "text_key string, shingles binary")
    out = seen.join(members, "text_key").groupBy("tie", "cls", "weight").agg(F.first("shingles").alias("shingles"))
    return stash(out, "tied-sets")


def jaccard_links(
    docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text",
    shortest: int = 4, longest: int = 6, recall: float = 0.9999, scouts: int = 4, crowd: int = 32,
) -> DataFrame:
    """``id_col``, text_key, n_links, class_id, kept for each row.

    n_links: other documents at least ``least`` similar; class_id: the smallest id reachable by
    links, its own included; kept: true for one document of each class; text_key: the text's MD5.
    """
    spark = docs.sparkSession
    kind = next(t for n, t in docs.dtypes if n == id_col)
    trees = trees_for(longest, least, recall) + scouts

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = multipliers(trees * longest)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys, root, tails, size = [], [], [], []
                for text in batch.column(3).to_pylist():
                    s = shingle_set(text, words)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    size.append(len(s))
                    if len(s):
                        paths = signature(s, mul, add).reshape(trees, longest)
                        root.append(roots(paths, shortest).view(np.int64))
                        tails.append((paths[:, shortest:] >> np.uint32(16)).astype(np.uint16).tobytes())
                    else:
                        root.append(np.zeros(0, np.int64))
                        tails.append(None)
                ends = np.cumsum([0] + [len(t) for t in root]).astype(np.int32)
                flat = np.concatenate(root) if root else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(tails, pa.binary())],
                    ["id", "row", "text_key", "set_key", "size", "roots", "tails"],
                )

    text = F.col(f"`{text_col}`")
    signed = stash(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), _key(text).alias("text_key"), text.alias("text"))
        .mapInArrow(sign, f"id {kind}, row bigint, text_key string, set_key binary, size bigint, roots array<bigint>, tails binary"),
        "signed",
    )
    # Copies have the same paths, so any row's will do.
    classes = stash(
        signed.where("set_key is not null").groupBy("set_key")
        .agg(F.min("row").alias("cls"), F.count("*").alias("weight"), F.min("text_key").alias("text_key"), F.first(F.struct("roots", "tails")).alias("path"))
        .select("set_key", "cls", "weight", "text_key", "path.roots", "path.tails"),
        "classes",
    )
    ties = forest_ties(classes, least, shortest, longest, recall, scouts, crowd)
    tied = stash(components(ties), "tied")
    members = stash(tied.select(F.col("node").alias("cls"), F.col("component").alias("tie")).join(classes.select("cls", "weight", "text_key"), "cls"), "tied-members")
    sets = tied_sets(docs, text_col, members, words)
    sums = sets.groupBy("tie").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    slices = F.ceil(F.greatest(F.col("n") / SLICE_ROWS, F.col("bytes") / SLICE_BYTES)).cast("int")
    sums = stash(sums.select("tie", "bytes", slices.alias("slices")), "tied-sums")
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    groups = max(partitions(spark), -(-total // SLICE_BYTES))
    cut = sets.join(sums.drop("bytes"), "tie")
    small = cut.where("slices = 1").select(
        F.pmod(F.xxhash64("tie"), F.lit(groups)).alias("task"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("slice"), "tie", "cls", "weight", "shingles"
    )
    large = cut.where("slices > 1").withColumn("slice", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        (-1 - F.col("tie")).alias("task"), F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "tie", "cls", "weight", "shingles"
    )

    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        rows = rows.sort_by([("tie", "ascending"), ("slice", "ascending"), ("cls", "ascending")])
        tie, cls, weight = (rows.column(c).to_numpy() for c in ("tie", "cls", "weight"))
        starts = np.flatnonzero(np.concatenate([[True], tie[1:] != tie[:-1]])) if len(tie) else np.zeros(0, int)
        count, parent = np.zeros(len(tie), np.int64), np.arange(len(tie))
        for lo, hi in zip(starts, [*starts[1:], len(tie)], strict=True):
            split = int((rows.column("slice").slice(lo, hi - lo).to_numpy() == i).sum()) if i != j else 0
            if i != j and split in (0, hi - lo):
                continue
            a, b = similar_pairs([_set(x) for x in rows.column("shingles").slice(lo, hi - lo).to_pylist()], least, split)
            np.add.at(count, lo + a, weight[lo + b])
            np.add.at(count, lo + b, weight[lo + a])
            union(parent, lo + a, lo + b)
        some = np.flatnonzero(count)
        return pa.table({"cls": pa.array(cls[some]), "links": pa.array(count[some]), "up": pa.array(cls[parent[some]])})

    found = stash(small.unionByName(large).groupBy("task", "i", "j").applyInArrow(verify, "cls bigint, links bigint, up bigint"), "links")
    release(ties, tied, members, sets, sums)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comp = stash(components(found.select(F.col("cls").alias("a"), F.col("up").alias("b"))), "components")
    known = classes.join(links, "cls", "left").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select(
        "set_key", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component")
    )
    # Rows without words join nothing; they are not sent to one place as null keys.
    worded = signed.where("set_key is not null").join(known, "set_key").select(
        "id", "row", "text_key", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component"
    )
    rows = stash(worded.unionByName(signed.where("set_key is null").select("id", "row", "text_key", F.lit(0).cast("bigint").alias("n_links"), F.col("row").alias("component"))), "members")
    least_of = stash(rows.groupBy("component").agg(F.min(F.struct("id", "row")).alias("_least")), "smallest")
    release(signed, classes, found, comp)
    return rows.join(least_of, "component").select(
        F.col("id").alias(id_col), "text_key", "n_links", F.col("_least.id").alias("class_id"), (F.col("row") == F.col("_least.row")).alias("kept")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, all columns; rows are told by id and text.

    What goes is left out by an anti-join, of those rows alone that a filter of its texts doesn't let through at once:
    the other texts are never moved, however many rows go.
    Of rows with the same id and text one stays, any of them; those without words all do.
    """
    names = ("__judged_id", "__judged_key")
    judged = jaccard_links(docs, id_col=id_col, text_col=text_col, **options)
    by = judged.groupBy(F.col(id_col).alias(names[0]), F.col("text_key").alias(names[1])).agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    by = stash(by.where("k < n"), "repeated")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & (_key(F.col(f"`{text_col}`")) == F.col(names[1]))
    marked = with_mark(docs, text_col, by, names[1], "__judged_maybe")
    maybe = marked.where("__judged_maybe").drop("__judged_maybe")
    rest = maybe.join(by.select(*names), same, "left_anti")
    again = maybe.join(by.where("k > 0").select(*names), same, "left_semi").withColumn("__text_key", _key(F.col(f"`{text_col}`")))
    return marked.where("not __judged_maybe").drop("__judged_maybe").unionByName(rest).unionByName(again.dropDuplicates([id_col, "__text_key"]).drop("__text_key"))
