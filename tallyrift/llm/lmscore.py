"""Language-model scores of whole texts: a unigram base, and online logistic mixing of byte contexts.

Texts are dealt into blocks of about ``BLOCK_BYTES`` where they lie, by the tasks that read them. A block
is written once, packed: its texts, as numbers of distinct units (words with what is behind), and its distinct
words with their counts. For each context its distinct keys with theirs are found from that row. Both are cut
into buckets, words by a checksum and keys by their first bits. A bucket's counts are summed over all blocks, and what they say of each word and key comes
back to the blocks that have it. So a word or key crosses the network twice for each block that has it, packed
with its neighbours, and nothing is broadcast but the code. Only packed texts and words are written as a table.

The mixing model's counts are of (context, byte), by keys of 60 bits; there are as many as the training
texts have, with no bound, as there are words. The number of buckets grows with the text, so what one
holds does not. No text is sampled or cut.

Null texts count as empty: their only token is the end. Repeated rows are texts of their own, and are
counted as often; very long texts are read whole. An empty table gives no rows; without any training
text all counts are zero, and the base of every token is log10(0.1 / 0.1). Only the columns named are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import bytemix
from .base import stash

BLOCK_BYTES, GROUP_BYTES, BUCKET_BYTES = 16 << 20, 2 << 20, 32 << 20
#: The kinds of packed rows besides the contexts, which are numbered from 0: a block's texts and its words.
TEXTS, WORDS = -1, bytemix.ORDERS


def tokens(text: bytes) -> list[bytes]:
    """The words, A-Z in lower case: of bytes, lower() and split() know no other letters and blanks."""
    return text.lower().split()


def unit_words(own: bytemix.Units) -> tuple[np.ndarray, list[bytes]]:
    """Which units hold a word, and these words."""
    return np.diff(own.edges) > 1, tokens(own.data.tobytes().replace(bytes([bytemix.EDGE]), b" "))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of these sizes that have ``most`` bytes or a little more."""
    ends = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    return zip([0, *ends.tolist()], [*ends.tolist(), len(sizes)], strict=True)


def _runs(texts: list[bytes], most: int) -> Iterator[slice]:
    """The texts in runs of ``most`` bytes or a little more."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def pack_units(found: pa.Array, number: np.ndarray) -> tuple[bytes, bytes]:
    """Texts as their distinct units and the number of each unit that comes."""
    return bytemix.squeezed(bytemix.unit_bytes(found).data.tobytes()), bytemix.packed(number.astype(np.int32))


def unpack_units(raw: bytes, number: bytes) -> tuple[pa.Array, np.ndarray]:
    data = np.frombuffer(bytemix.restored(raw), np.uint8)
    return bytemix.as_units(data), bytemix.unpacked(number, np.int32)


def unpack_texts(raw: bytes, number: bytes) -> list[bytes]:
    found, of = unpack_units(raw, number)
    return bytemix.unit_bytes(found).joined(of).tobytes().split(bytes([bytemix.EDGE]))[:-1]


def text_runs(found: pa.Array, number: np.ndarray) -> np.ndarray:
    """Where the units of each text begin, and those of the last one end."""
    own = bytemix.unit_bytes(found)
    ends = own.data[own.edges[1:] - 1] == bytemix.EDGE
    return np.append(0, np.flatnonzero(ends[number]) + 1)


def pack_words(words: list[bytes]) -> bytes:
    """Sorted words, which hold no blanks; the empty one stands for the end of a text."""
    return bytemix.squeezed(b" ".join(words))


def unpack_words(raw: bytes) -> list[bytes]:
    return bytemix.restored(raw).split(b" ")


def _rows(block: int, parts: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Of (k, bucket, a, b, ids, trains)."""
    k, bucket, a, b, ids, trains = zip(*parts, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(parts), pa.int64()), pa.array(k, pa.int32()), pa.array(bucket, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(ids, pa.list_(kind)), pa.array(trains, pa.list_(pa.bool_()))],
        ["block", "k", "bucket", "a", "b", "ids", "trains"],
    )


def block_rows(texts: list[bytes], ids: list, trains: list[bool], cut: int) -> Iterator[tuple]:
    """The packed texts of one block, and its words, cut into 2^cut buckets."""
    data, sizes = bytemix.joined(texts)
    found, number, first = bytemix.units(data)
    n = np.bincount(number, np.repeat(np.array(trains, bool), sizes)[first], len(found)).astype(np.int64)
    yield (TEXTS, 0, *pack_units(found, number), ids, trains)
    del data, number, first
    filled, words = unit_words(bytemix.unit_bytes(found))
    known: dict[bytes, int] = {}
    get = known.get
    for w, c in zip(words, n[filled].tolist(), strict=True):
        known[w] = get(w, 0) + c
    known[b""] = sum(trains)
    buckets: list[list[bytes]] = [[] for _ in range(1 << cut)]
    for w in sorted(known):
        buckets[zlib.crc32(w) & (1 << cut) - 1].append(w)
    for i, own in enumerate(buckets):
        if own:
            yield WORDS, i, pack_words(own), bytemix.packed(np.array([known[w] for w in own], np.int32)), None, None


def key_rows(found: pa.Array, number: np.ndarray, trains: list[bool], cut: int) -> Iterator[tuple]:
    """The packed keys of one block's texts and their counts, for each context, cut into 2^cut buckets."""
    flags, seen, own, at = np.array(trains, bool), bytemix.KeyCounts(), bytemix.unit_bytes(found), text_runs(found, number)
    seen.units.put(found, np.bincount(number, np.repeat(flags, np.diff(at)), len(found)))
    size = np.add.reduceat(np.diff(own.edges)[number], at[:-1])
    for lo, hi in _cuts(size, seen.RUN):
        seen.near(own.joined(number[at[lo] : at[hi]]), np.repeat(flags[lo:hi].astype(np.int64), size[lo:hi]))
    edges = np.arange(1, 1 << cut) << bytemix.KEY_BITS - cut
    for k in range(bytemix.ORDERS):
        key, count = seen.of(k)
        ends = [0, *np.searchsorted(key, edges).tolist(), len(key)]
        for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if lo < hi:
                yield k, i, bytemix.packed(np.diff(key[lo:hi], prepend=0)), bytemix.packed(count[lo:hi].astype(np.int32))


def lm_scores(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, trains, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte for each row."""
    sc = docs.sparkSession.sparkContext
    id_type = docs.schema[id_col].dataType
    kind, arrow = id_type.simpleString(), to_arrow_type(id_type)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(trains, F.lit(False)).alias("trains"), F.col(f"`{text_col}`").alias("text"))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, every = [], 0
        for batch in batches:
            flags = batch.column(0).to_pylist()
            raw = [_bytes(t) for t in batch.column(1).to_pylist()]
            every += sum(map(len, raw)) + len(raw)
            for at in _runs(raw, 1 << 20):
                seen.append(bytemix.triples([t for t, f in zip(raw[at], flags[at], strict=True) if f]))
                seen = [bytemix.added(seen)] if len(seen) > 16 else seen
        triple, n = bytemix.added(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(triple, [-1, -2])), pa.array(np.append(n, [every, 1]))], ["triple", "n"])

    # How often each three bytes came (2^24 rows could be, some ten thousand are), all bytes, and how many partitions there are.
    counted = texts.select("trains", "text").mapInArrow(histogram, "triple bigint, n bigint").groupBy("triple").agg(F.sum("n").alias("n")).toArrow().sort_by("triple")
    triple, n = counted.column("triple").to_numpy(), counted.column("n").to_numpy()
    code = sc.broadcast(bytemix.huffman(triple[triple >= 0], n[triple >= 0]))
    every, parts = int(n[triple == -1].sum()), int(n[triple == -2].sum()) or 1
    cut = max(0, (every // BUCKET_BYTES).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of one partition; their numbers are its own."""
        block = TaskContext.get().partitionId() << 32
        held, ids, flags, size = [], [], [], 0
        for batch in batches:
            for i, f, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(_bytes(t))
                ids.append(i)
                flags.append(f)
                size += len(held[-1]) + 1
                if size >= BLOCK_BYTES:
                    for row in block_rows(held, ids, flags, cut):
                        yield _rows(block, [row], arrow)
                    block, held, ids, flags, size = block + 1, [], [], [], 0
        if held:
            for row in block_rows(held, ids, flags, cut):
                yield _rows(block, [row], arrow)

    schema = f"block bigint, k int, bucket int, a binary, b binary, ids array<{kind}>, trains array<boolean>"
    # Small partitions are put together, without a shuffle, so that blocks are full.
    few = max(1, min(parts, max(-(-every // BLOCK_BYTES), sc.defaultParallelism)))
    blocks = stash(texts.coalesce(few).mapInArrow(pack, schema), "blocks")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b, trains in zip(*(batch.column(i) for i in range(4)), strict=True):
                for k, i, key, n in key_rows(*unpack_units(a.as_py(), b.as_py()), trains.as_py(), cut):
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([key], pa.binary()), pa.array([n], pa.binary())], ["block", "k", "bucket", "a", "b"])

    def words_of(rows: pa.Table) -> dict[bytes, int]:
        total: dict[bytes, int] = {}
        get = total.get
        for raw, n in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True):
            for w, c in zip(unpack_words(raw), bytemix.unpacked(n, np.int32).tolist(), strict=True):
                total[w] = get(w, 0) + c
        return total

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        """What is said of the keys or words of one bucket, to each block that has them."""
        k = key[0].as_py()
        sent, out = rows.column("a").to_pylist(), []
        if k == WORDS:
            total = words_of(rows)
            for raw in sent:
                own = unpack_words(raw)
                out.append(bytemix.packed(np.fromiter(map(total.__getitem__, own), np.int64, len(own))))
        else:
            times = [bytemix.unpacked(b, np.int32) for b in rows.column("b").to_pylist()]
            held = [np.cumsum(bytemix.unpacked(a, np.int64)) for a in sent]
            every_key, n = bytemix.distinct(np.concatenate(held), np.concatenate(times).astype(np.int64))
            start, size, said = bytemix.answers(code.value, every_key, n)
            for own in held:
                at = np.searchsorted(every_key, own)
                out.append(bytemix.squeezed(said[bytemix.flat(start[at], size[at])].tobytes()))
        return pa.table({"block": rows.column("block"), "k": rows.column("k"), "bucket": rows.column("bucket"), "a": rows.column("a"), "b": pa.array(out, pa.binary())})

    def count_words(rows: pa.Table) -> pa.Table:
        own = words_of(rows)
        return pa.table({"total": [sum(own.values())], "known": [sum(c > 0 for c in own.values())], "ends": [own.get(b"", 0)]})

    words = blocks.where(f"k = {WORDS}").select("block", "k", "bucket", "a", "b")
    # Sums of a row for each bucket of words.
    totals = words.groupBy("bucket").applyInArrow(count_words, "total bigint, known bigint, ends bigint").agg(F.sum("total"), F.sum("known"), F.sum("ends")).first()
    total, distinct, ends = (int(x or 0) for x in totals)
    schema = "block bigint, k int, bucket int, a binary, b binary"
    asked = blocks.where(f"k = {TEXTS}").select("block", "a", "b", "trains").mapInArrow(keyed, schema).unionByName(words)
    answered = asked.groupBy("k", "bucket").applyInArrow(answer, schema)

    def judge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("k", "ascending"), ("bucket", "ascending")])
        k, a, b = (rows.column(c).to_pylist() for c in ("k", "a", "b"))
        of: dict[bytes, float] = {}
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(bytemix.ORDERS)]
        for i, what in enumerate(k):
            if what == TEXTS:
                found, number = unpack_units(a[i], b[i])
                ids, flags = rows.column("ids")[i].values, rows.column("trains")[i].values
            elif what == WORDS:
                of.update(zip(unpack_words(a[i]), np.log10(bytemix.unpacked(b[i], np.int64) + 0.1).tolist(), strict=True))
            else:
                parts[what].append((np.cumsum(bytemix.unpacked(a[i], np.int64)), np.frombuffer(bytemix.restored(b[i]), np.int8)))
        del a, b
        tables = [tuple(np.concatenate(c) for c in zip(*p, strict=True)) for p in parts]
        model, own = bytemix.Known(code.value, tables, []), bytemix.unit_bytes(found)
        del tables, parts
        model.know(own)
        del model.word  # no other units come
        new, end = math.log10(0.1), math.log10(ends + 0.1)
        filled, words = unit_words(own)
        value = np.zeros(len(filled))
        value[filled] = np.fromiter(map(of.__getitem__, words), np.float64, len(words))
        of.clear()
        # Sums over the units of each text.
        at = text_runs(found, number)
        size, n_tokens, n_known, base = (np.add.reduceat(x[number], at[:-1]) for x in (np.diff(own.edges), filled.astype(np.int64), (filled & (value > new + 1e-9)).astype(np.int64), value))
        n_tokens, n_known, base, score = n_tokens + 1, n_known + (ends > 0), base + end, np.zeros(len(size))
        # Texts of like lengths go forward together.
        order = np.argsort(size, kind="stable")
        for lo, hi in _cuts(size[order], GROUP_BYTES):
            which = order[lo:hi]
            data = model.read(number[bytemix.flat(at[which], np.diff(at)[which])])
            score[which] = bytemix.score(code.value, model, data.tobytes().split(bytes([bytemix.EDGE]))[:-1])
        base -= n_tokens * math.log10(total + 0.1 * (distinct + 1))
        return pa.table({
            "id": ids, "trains": flags, "n_tokens": pa.array(n_tokens), "n_known": pa.array(n_known),
            "base_score": pa.array(base), "score": pa.array(score / math.log(10)), "bits_per_byte": pa.array(-score / math.log(2) / size),
        })

    held = blocks.where(f"k = {TEXTS}").unionByName(answered, allowMissingColumns=True)
    schema = f"id {kind}, trains boolean, n_tokens bigint, n_known bigint, base_score double, score double, bits_per_byte double"
    out = held.groupBy("block").applyInArrow(judge, schema)
    return out.select(F.col("id").alias(id_col), "trains", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score", "bits_per_byte")
