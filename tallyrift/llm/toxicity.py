"""Toxicity: the nearest labelled examples by exact TF-IDF cosine vote, weighted by distance.

Labelled examples are a bounded sample: at most ``most`` of each label, those whose ids hash least.
Terms are words and the first four letters of words, all of those that an example has; none is
cut. A term weighs (1 + log tf) * idf * telling: idf from the document frequencies over all documents,
telling from the sample, the logarithm of the odds that a toxic example has it against a clean one
(without it, words that say nothing drown those that do: see the README). Terms that no example has
can't match any and are left out of a text's length. The index, whose size those bounds fix, is broadcast.

The index is inverted, by blocks of examples: a term has an entry for each block that holds it, with
the largest weight there and where its postings begin. A block's bound is a sum over the query's
entries; blocks are evaluated in the order of their bounds until the next bound is below the k-th best
cosine, so the search is exact. Equal cosines at the k-th place all vote. Votes become scores by a
monotonic fit of the sample's own leave-one-out votes, each label weighted by how many rows have it.

Texts that are null, empty or share no term with any example are nearest to nothing: their score is
the share of toxic ones among such examples. Labels of ids that aren't in the documents, and null
labels, count for nothing; an id with several labels is toxic if one of them is, one with several
texts stands for the least of them. Repeated rows are scored one by one; very long texts are read
whole; an empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .base import release, stash

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64
STARTS = (4,)
#: Characters of the words that a Python worker remembers, and of the longest of them.
KNOWN_CHARS, LONGEST = 2_000_000, 64
#: Characters of the texts that are matched at once.
BATCH = 1_000_000
#: Terms that so large a share of the examples has become rows of a matrix where they are searched.
COMMON = 0.12


#: Of ASCII texts in lower case, all but letters made blank.
LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))


def words_of(lower: str) -> list[str]:
    """The words of a text in lower case; those of ASCII texts are cut at blanks."""
    return lower.encode().translate(LETTERS).decode().split() if lower.isascii() else WORD.findall(lower)


def _terms(word: str) -> list[str]:
    """A word's terms; a star ends the beginning of a word."""
    return [word, *(word[:size] + "*" for size in STARTS if len(word) >= size)]


def terms_of(text: str | None) -> dict[str, int]:
    """How often each term occurs."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower()) if text else ()).items():
        for t in _terms(w):
            out[t] += n
    return dict(out)


class Matcher(dict):
    """The terms of texts that are in a vocabulary, by number. Words already seen are remembered, up to a size.

    Words of the same terms have one number, as most words of a text are rare and have none, or only those of their beginning.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        self.place = {t: i for i, t in enumerate(vocabulary.split("\n"))} if vocabulary else {}
        self.begun = {t[:-1]: i for t, i in self.place.items() if t[-1] == "*"}
        self.of: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.held = 0

    def __missing__(self, word: str) -> int:
        begun, i = self.begun, self.place.get(word)
        terms = () if i is None else (i,)
        for start in STARTS:
            if (i := begun.get(word[:start])) is not None and len(word) >= start:
                terms += (i,)
        number = self.numbers.get(terms)
        if number is None:
            number = self.numbers[terms] = len(self.of)
            self.of.append(terms)
        if (size := len(word)) <= LONGEST:
            self[word] = number
            self.held += size + 8
        return number

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each text's terms begin, one more at the end; terms in order; how often each)."""
        if self.held > KNOWN_CHARS:
            self.clear()
            self.of, self.numbers, self.held = [], {}, 0
        words = [words_of(t.lower()) if t else [] for t in texts]
        sizes = [len(w) for w in words]
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        wide = max(len(self.of), 1)
        key, n = np.unique(np.repeat(np.arange(len(texts)), sizes) * wide + number, return_counts=True)
        doc, number = np.divmod(key, wide)
        some, where = np.unique(number, return_inverse=True)
        terms = [self.of[i] for i in some.tolist()]
        long = np.array([len(t) for t in terms], np.int64)
        every = np.fromiter(chain.from_iterable(terms), np.int64, int(long.sum()))
        size = long[where]
        term = every[flat((np.cumsum(long) - long)[where], size)]
        key = np.repeat(doc, size) * max(len(self.place), 1) + term
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.repeat(n, size)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        doc, term = np.divmod(key[first], max(len(self.place), 1))
        return np.searchsorted(doc, np.arange(len(texts) + 1)), term, np.add.reduceat(n, first) if len(first) else n


def batches(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a column in runs of BATCH characters or a little more, each with its first row; not more than 1024 are held."""
    for lo in range(0, len(column), 1024):
        texts = column.slice(lo, 1024).to_pylist()
        at = held = 0
        for i, t in enumerate(texts):
            held += len(t or "") + 100
            if held >= BATCH:
                yield lo + at, texts[at : i + 1]
                at, held = i + 1, 0
        if at < len(texts):
            yield lo + at, texts[at:]


def matched(incoming: Iterator[pa.RecordBatch], match: Matcher, spot: int, keep: int) -> Iterator[pa.RecordBatch]:
    """The first ``keep`` columns, and the numbers of each text's terms and how often each, packed; ``spot``: the column of texts."""
    for whole in incoming:
        for lo, texts in batches(whole.column(spot)):
            begin, *values = match(texts)
            ends = pa.py_buffer((begin * 4).astype(np.int32))
            cols = [pa.Array.from_buffers(pa.binary(), len(texts), [None, ends, pa.py_buffer(v.astype(np.int32))]) for v in values]
            yield pa.RecordBatch.from_arrays([*whole.slice(lo, len(texts)).columns[:keep], *cols], [*(f"c{i}" for i in range(keep)), "terms", "tf"])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's values begin, one more at the end; all values."""
    rows = column.to_pylist()
    return np.append(0, np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)), np.frombuffer(b"".join(rows), np.int32)


def flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    """The examples' terms as postings, by term, then example; ``prepare`` gives their weights, entries and blocks.

    What is sent to the workers is the postings alone.
    """

    vocabulary: str  # all terms, one a line; those that most examples have first
    weight: np.ndarray  # idf * telling of each term
    toxic: np.ndarray  # of each example
    ids: list
    many: np.ndarray  # how many postings each term has
    example: np.ndarray  # of each posting
    tf: np.ndarray
    size: np.ndarray  # the length of each example's vector
    wide: int = 0  # so many terms, the first ones, are common
    share: float = 0.0  # of toxic rows
    none: float = 0.0  # the score of texts without neighbours
    votes: np.ndarray | None = None  # the fit from votes to scores
    scores: np.ndarray | None = None
    _matcher: Matcher | None = field(default=None, repr=False)
    _common: np.ndarray | None = field(default=None, repr=False)

    def prepare(self) -> Index:
        """entries: where each term's begin; block, most, postings: of each entry its block, largest weight, first posting."""
        term = np.repeat(np.arange(len(self.many)), self.many)
        self.value = (1 + np.log(self.tf.astype(float))) * self.weight[term] / self.size[self.example] if len(term) else np.zeros(0)
        key = term * (len(self.toxic) // BLOCK + 1) + self.example // BLOCK
        del term
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.block = (self.example[begin] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.value, begin) if len(key) else np.zeros(0)
        self.postings = np.append(begin, len(key)).astype(np.int32)
        self.entries = np.searchsorted(begin, np.append(0, np.cumsum(self.many))).astype(np.int32)
        return self

    def __getstate__(self) -> dict:
        small = {k: v for k, v in self.__dict__.items() if k not in ("value", "block", "most", "postings", "entries", "_matcher", "_common")}
        small["vocabulary"] = zlib.compress(self.vocabulary.encode(), 6)
        small["example"], small["tf"] = ((zlib.compress(x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes(), 1), np.min_scalar_type(int(x.max(initial=0))).str) for x in (self.example, self.tf))
        return small

    def __setstate__(self, small: dict) -> None:
        self.__dict__.update(small, _matcher=None, _common=None, vocabulary=zlib.decompress(small["vocabulary"]).decode())
        self.example, self.tf = (np.frombuffer(zlib.decompress(raw), kind).astype(np.int32) for raw, kind in (small["example"], small["tf"]))
        self.prepare()

    def matcher(self) -> Matcher:
        """Made once in each worker."""
        if self._matcher is None:
            self._matcher = Matcher(self.vocabulary)
        return self._matcher

    @property
    def common(self) -> np.ndarray:
        """The common terms' weights in all examples, made of their postings once in each worker."""
        if self._common is None:
            self._common = np.zeros((self.wide, len(self.toxic)))
            last = self.entries[self.wide] if len(self.entries) else 0
            term = np.repeat(np.arange(self.wide), np.diff(self.postings[self.entries[: self.wide + 1]])) if last else np.zeros(0, np.int64)
            self._common[term, self.example[: len(term)]] = self.value[: len(term)]
        return self._common

    def unit(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.weight[ids]
        size = np.sqrt((w**2).sum())
        return w / size if size > 0 else w

    def all_nearest(self, begin: np.ndarray, terms: np.ndarray, tf: np.ndarray, k: int, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for each of some texts, as a matcher gives them; ``own``: they are the examples, and none is its own neighbour."""
        for lo in range(0, len(begin) - 1, 128):
            at = begin[lo : lo + 129]
            units = [self.unit(terms[a:b], tf[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            dense = np.zeros((len(units), self.wide))
            for i, (a, w) in enumerate(zip(at, units, strict=False)):
                n = int(np.searchsorted(terms[a : a + len(w)], self.wide))
                dense[i, terms[a : a + n]] = w[:n]
            for i, (a, w, base) in enumerate(zip(at, units, dense @ self.common, strict=False)):
                yield self.nearest(terms[a : a + len(w)], w, k, base, lo + i if own else -1)

    def nearest(self, ids: np.ndarray, w: np.ndarray, k: int, base: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine, with all that tie with the last, and their cosines.

        ``base``: what the common terms add to each cosine; ``skip``: an example to leave out.
        """
        rest = int(np.searchsorted(ids, self.wide))
        n = len(self.toxic)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        ids, w = ids[rest:], w[rest:]
        first = self.entries[ids]
        size = self.entries[ids + 1] - first
        at = flat(first, size)
        own = np.repeat(w, size)
        of = self.block[at]
        blocks = -(-n // BLOCK)
        bound = np.bincount(of, self.most[at] * own, blocks) + np.maximum.reduceat(base, np.arange(0, n, BLOCK)) + 1e-9
        cos = base.copy()
        if skip >= 0:
            cos[skip] = 0
        least = np.partition(cos, n - k)[n - k] if n >= k else 0.0
        order = np.argsort(-bound, kind="stable")
        done, step = 0, 4
        while done < blocks and bound[order[done]] >= least:
            now = np.zeros(blocks, bool)
            now[order[done : done + step]] = True
            some = np.flatnonzero(now[of])
            begin = self.postings[at[some]]
            many = self.postings[at[some] + 1] - begin
            spot = flat(begin, many)
            cos += np.bincount(self.example[spot], self.value[spot] * np.repeat(own[some], many), n)
            if skip >= 0:
                cos[skip] = 0
            least = np.partition(cos, n - k)[n - k] if n >= k else 0.0
            done, step = done + step, step * 4
        good = np.flatnonzero(cos >= max(least * (1 - 1e-12), 1e-8))
        best = good[np.argsort(-cos[good], kind="stable")]
        return best, cos[best]

    def vote(self, near: np.ndarray, cos: np.ndarray) -> float:
        """The share of toxic ones, weighted by distance; one more vote, at distance one, is that of all rows."""
        w = 1 / (1.05 - cos)
        return float(((w * self.toxic[near]).sum() + self.share / 1.05) / (w.sum() + 1 / 1.05))

    def score(self, near: np.ndarray, cos: np.ndarray) -> float:
        if not len(near):
            return self.none
        v = self.vote(near, cos)
        fit = float(np.interp(v, self.votes, self.scores)) if self.votes is not None and len(self.votes) else v
        return 0.97 * fit + 0.03 * v


def monotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the increasing step fit of y on x by weighted least squares, with one row of doubt at each end."""
    xs, where = np.unique(x, return_inverse=True)
    ws, ys = np.bincount(where, w), np.bincount(where, w * y)
    pools: list[list[float]] = []
    for a, s, t in zip(xs, ws, ys, strict=True):
        pools.append([a, a, s, t])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    px, py = [], []
    for lo, hi, s, t in pools:
        value = (t + 0.5 * w.min()) / (s + w.min())
        px += [lo, hi]
        py += [value, value]
    return np.array(px), np.maximum.accumulate(np.array(py))


def telling(with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """How far the odds of each term in toxic examples are from those in clean ones, by their logarithm."""
    return np.abs(np.log((with_toxic + 0.5) / (toxic + 1)) - np.log((with_clean + 0.5) / (clean + 1)))


def build(ids: list, toxic: np.ndarray, vocabulary: list[str], begin: np.ndarray, term: np.ndarray, tf: np.ndarray, df: np.ndarray, n: int, rows: tuple[int, int], k: int) -> Index:
    """The index of examples; ``term``, ``tf``: theirs one after the other, each's from ``begin`` on; ``rows``: how many clean and toxic rows there are."""
    size, count, wide = (int((toxic == 0).sum()), int((toxic == 1).sum())), len(ids), len(vocabulary)
    example = np.repeat(np.arange(count, dtype=np.int32), np.diff(begin))
    has = [np.bincount(term[toxic[example] == label], minlength=wide) for label in (0, 1)]
    weight = (np.log((n + 1) / (df + 1)) + 1e-3) * telling(has[1], has[0], size[1], size[0])
    # Common terms first.
    order = np.argsort(-(has[0] + has[1]), kind="stable")
    new = np.empty(wide, np.int32)
    new[order] = np.arange(wide, dtype=np.int32)
    term, weight, named = new[term], weight[order], "\n".join([vocabulary[i] for i in order.tolist()])
    common = int((has[0] + has[1] >= max(COMMON * count, 1)).sum()) if count else 0
    value = (1 + np.log(tf)) * weight[term]
    length = np.sqrt(np.bincount(example, value**2, count))
    length[length == 0] = 1
    # Examples with the same strongest term stand together, so that blocks differ.
    strongest = np.full(count, -1)
    by = np.lexsort((-value, example))
    some = np.flatnonzero(np.diff(begin))
    strongest[some] = term[by[begin[some]]]
    order = np.argsort(strongest, kind="stable")
    place = np.empty(count, np.int32)
    place[order] = np.arange(count, dtype=np.int32)
    example = place[example]
    by = np.lexsort((example, term))
    index = Index(named, weight, toxic[order].astype(float), [ids[i] for i in order.tolist()], np.bincount(term, minlength=wide), example[by], tf[by].astype(np.int32), length[order], common)
    index.prepare()
    by = np.lexsort((term, example))
    begin, term, tf = np.searchsorted(example[by], np.arange(count + 1)), term[by], tf[by]
    del by, example, value
    index.share = rows[1] / max(sum(rows), 1)
    share = np.array([rows[y] / max(size[y], 1) for y in (0, 1)])
    votes, ys, ws, alone = [], [], [], [0.5, 0.05]
    for j, (near, cos) in enumerate(index.all_nearest(begin, term, tf, k, own=True)):
        y = int(index.toxic[j])
        if len(near):
            votes.append(index.vote(near, cos))
            ys.append(y)
            ws.append(share[y])
        else:
            alone = [alone[0] + share[y], alone[1] + share[y] * y]
    index.none = alone[1] / alone[0]
    if votes:
        index.votes, index.scores = monotonic(np.array(votes), np.array(ys, float), np.array(ws))
    return index


def fit(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str, text_col: str, label_col: str, k: int, most: int, keep: tuple[str, ...] = ()) -> tuple[Index, DataFrame | None]:
    """The index, and if there is something to keep, that of all rows as c0, c1 and so on with what ``matched`` finds in their texts.

    ``trains``: which ids of ``labels`` may be learned from.
    """
    spark = docs.sparkSession
    marked = labels.where(trains & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    known = texts.select("_id").where("_id is not null").distinct().join(marked, "_id")
    rows = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    # The bounded sample: two times ``most`` examples at most.
    pick = lambda y: known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
    chosen = stash(pick(0).unionByName(pick(1)), "chosen")
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))

    def split(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            found = [terms_of(t) for t in batch.column(2).to_pylist()]
            terms, tf = pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, tf], ["_id", "_y", "terms", "tf"])

    kind = dict(docs.dtypes)[id_col]
    examples = sample.select("_id", F.col("_y").cast("int").alias("_y"), "_text").mapInArrow(split, f"_id {kind}, _y int, terms array<string>, tf array<bigint>")
    # At most two times ``most`` rows reach the driver.
    got = examples.toArrow().sort_by([("_y", "ascending"), ("_id", "ascending")]).combine_chunks()
    release(chosen)
    ids, toxic = got.column("_id").to_pylist(), got.column("_y").to_numpy()
    begin = np.append(0, np.cumsum(pc.list_value_length(got.column("tf")).to_numpy())).astype(np.int64)
    tf = pa.concat_arrays([pa.array([], pa.int64()), *(c.flatten() for c in got.column("tf").chunks)]).to_numpy().astype(np.int32)
    coded = pa.concat_arrays([pa.array([], pa.string()), *(c.flatten() for c in got.column("terms").chunks)]).dictionary_encode()
    vocabulary, term = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int32)
    del got, coded
    # Common terms first, as in the index, then in the order of the terms, whatever the order of arrival.
    has = np.bincount(term, minlength=len(vocabulary))
    order = sorted(range(len(vocabulary)), key=lambda i: (-has[i], vocabulary[i]))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    vocabulary, term = [vocabulary[i] for i in order], rank[term]
    del order, rank
    held = spark.sparkContext.broadcast("\n".join(vocabulary))

    def count(found: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(wide, np.int64), 0
        for batch in found:
            for lo in range(0, batch.num_rows, 1024):
                df += np.bincount(unpacked(batch.column("terms").slice(lo, 1024))[1], minlength=wide)
            n += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["term", "n"])

    # Document frequencies over all documents: a row for each term of the sample reaches the driver.
    wide, found = len(vocabulary), None
    if keep:
        kinds, names = dict(docs.dtypes), [f"c{i}" for i in range(len(keep))]
        sent = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], F.col(f"`{text_col}`").alias("_text"))
        schema = ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(names, keep, strict=True)), "terms binary", "tf binary"])
        found = stash(sent.mapInArrow(lambda b: matched(b, Matcher(held.value), len(keep), len(keep)), schema), "matched")
        counts = found.select("terms").mapInArrow(lambda b: count(b, wide), "term bigint, n bigint")
    else:
        counts = texts.select("_text").mapInArrow(lambda b: count(matched(b, Matcher(held.value), 0, 0), wide), "term bigint, n bigint")
    counted = counts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held.unpersist()
    df, n, at = np.zeros(len(vocabulary), np.int64), counted.column("n").to_numpy(), counted.column("term").to_numpy()
    df[at[at >= 0]] = n[at >= 0]
    return build(ids, toxic, vocabulary, begin, term, tf, df, int(n[at < 0].sum()), (rows.get(0, 0), rows.get(1, 0)), k), found


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    keep: tuple[str, ...] = (), names: tuple[str, str] = ("score", "evidence"), k: int = 15, most: int = 1250,
) -> DataFrame:
    """``keep`` or ``id_col``, score, evidence (ids of the nearest examples, at most three) for each row.

    ``names``: what the last two are called, for rows that have columns of those names. What is found in the texts is written
    once; if the texts themselves are kept, it is found twice, so that they aren't written again.
    """
    keep = keep or (id_col,)
    spot = keep.index(text_col) if text_col in keep else -1
    fitted, found = fit(docs, labels, trains, id_col, text_col, label_col, k, most, () if spot >= 0 else keep)
    index = docs.sparkSession.sparkContext.broadcast(fitted)
    kinds = dict(docs.dtypes)
    named = to_arrow_type(docs.schema[id_col].dataType)

    def judge(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for whole in matched(incoming, at.matcher(), spot, len(keep)) if spot >= 0 else incoming:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                score, near = [], []
                for rows, cos in at.all_nearest(*unpacked(batch.column("terms")), unpacked(batch.column("tf"))[1], k):
                    score.append(at.score(rows, cos))
                    near.append([at.ids[i] for i in rows[:3]])
                cols = [*batch.columns[: len(keep)], pa.array(score, pa.float64()), pa.array(near, pa.list_(named))]
                yield pa.RecordBatch.from_arrays(cols, [*plain, "score", "evidence"])

    # Names with a dot don't pass through mapInArrow, so columns go by number there.
    plain = [f"c{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {kinds[c]}" for n, c in zip(plain, keep, strict=True)) + f", score double, evidence array<{kinds[id_col]}>"
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(plain, keep, strict=True)]) if found is None else found
    return rows.mapInArrow(judge, schema).toDF(*keep, *names)
