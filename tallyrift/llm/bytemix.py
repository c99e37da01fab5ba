"""A byte model by logistic mixing of the bit predictors of contexts.

Bytes are coded by the bits of Huffman codes, one for each two bytes before, some two and a half bits each;
a byte that never followed those is coded by an escape and the code of the one byte before. Each bit has
one predictor for each context: the last three and the last four bytes, and the word so far, with the two
bytes before. (What those two alone say is in the codes.) What is counted is how often a byte came in a
context, by a key of 60 bits (``keys``); the counts of the bits are sums over the bytes below a node of
the code tree (``answers``). Any number of keys may be counted, as no table has a fixed size. A predictor
speaks by the logarithm of its odds, gated by its evidence: few counts say little, none are silent.
Weights add these up. There is a set of weights for each place in a word (``gates``), and the set in use is
refined along the whole text by its errors: after each byte at first, and then after stretches that grow as
the text does (``stretches``), as weights that have seen much change little. The rule goes by the place in the
text alone, and a text of n bytes takes some ``EACH`` * (1 + ln(n / EACH)) refinements.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

#: Comes before and after each text; no UTF-8 text has it.
EDGE = 255
#: The contexts' weights at each start: last three bytes, word so far, last four.
FIRST = np.array([0.2, 0.5, 0.45], np.float32)
RATE = 0.02
#: Weights are refined after each of so many bytes, then after stretches of one byte more for every EACH bytes before.
EACH = 128
#: A stretch moves the weights as this many of its bytes would, at most.
MOST = 16
#: Sets of weights: after so many bytes of a word, or more.
GATES = 4
ORDERS, KEY_BITS = 3, 60
#: What predictors say is kept in so many steps to the unit.
STEPS = 8
#: Keys that are answered at once.
ANSWERED = 1 << 17
#: Bytes whose predictors are looked up at once.
WINDOW = 60_000
#: What ends a word: blanks, and the end of a text.
GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14), EDGE]] = True
#: Of bytes in words, A-Z as in lower case.
NUMBER = np.arange(1, 257, dtype=np.uint64)
NUMBER[65:91] += np.uint64(32)
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
#: Scrambles 32 bits, and back.
SCRAMBLE, UNSCRAMBLE = 0x85EBCA6B, pow(0x85EBCA6B, -1, 1 << 32)
LOW = 0xFFFFFFFF


ESCAPE = 256


def flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Code:
    """Paths as nodes (numbered within what comes before) and bits, one after the other, and where each begins.

    ``place``: for two bytes the number of their code, or -1; ``start``, ``size``: by code and byte, or ESCAPE;
    no size where a byte never came. ``pair_start``, ``pair_size``: by the byte before and the byte.
    """

    nodes: np.ndarray
    bits: np.ndarray
    place: np.ndarray
    start: np.ndarray
    size: np.ndarray
    pair_start: np.ndarray
    pair_size: np.ndarray

    def paths(self, two: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits each byte has after the two before, and which ones."""
        code = self.place[two]
        number = code * 257 + byte
        size = np.where(code >= 0, self.size[number], 0)
        first = self.start[number].astype(np.int64)
        other = np.flatnonzero(size == 0)  # by an escape, if there is a code, and the code of one byte
        escape = np.maximum(code[other], 0) * 257 + ESCAPE
        ahead = np.where(code[other] >= 0, self.size[escape], 0)
        pair = (two[other] & 255) << 8 | byte[other]
        size = size.astype(np.int64)
        size[other] = ahead + self.pair_size[pair]
        first[other] = self.start[escape]
        at = flat(first, size)
        begin = np.cumsum(size)[other] - size[other] + ahead
        at[flat(begin, self.pair_size[pair])] = flat(self.pair_start[pair], self.pair_size[pair])
        return size, at


def _paths(counts: list[int]) -> list[list[tuple[int, int]]]:
    """The Huffman code of each of some symbols, two at least, as (inner node, bit); symbols of no count have one too."""
    n = len(counts)
    heap = [(c * 512 + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    inner: list[tuple[int, int]] = []
    while len(heap) > 1:
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (x + y, n + len(inner)))
        inner.append((a, b))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    stack: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][1], [])]
    while stack:
        at, path = stack.pop()
        if at < n:
            paths[at] = path
        else:
            for bit, under in enumerate(inner[at - n]):
                stack.append((under, [*path, (at - n, bit)]))
    return paths


def huffman(triple: np.ndarray, count: np.ndarray) -> Code:
    """The codes of counts by (two bytes before, byte), as numbers of 24 bits in order. A byte that nothing follows has the code of all."""
    pairs = np.bincount(triple & 0xFFFF, count, 1 << 16).astype(np.int64).reshape(256, 256)
    nodes, bits, pair_size = [], [], []
    common = _paths(pairs.sum(0).tolist())
    for before in range(256):
        for path in _paths(pairs[before].tolist()) if pairs[before].any() else common:
            pair_size.append(len(path))
            nodes += [256 + n for n, _ in path]
            bits += [b for _, b in path]
    twos, begin = np.unique(triple >> 8, return_index=True)
    place = np.full(1 << 16, -1, np.int64)
    place[twos] = np.arange(len(twos))
    size, start = np.zeros(max(len(twos), 1) * 257, np.uint8), np.zeros(max(len(twos), 1) * 257, np.int32)
    for code, (lo, hi) in enumerate(zip(begin.tolist(), np.append(begin[1:], len(triple)).tolist(), strict=False)):
        # As likely an escape as there are bytes that had to come a first time.
        own = [*(triple[lo:hi] & 255).tolist(), ESCAPE]
        for byte, path in zip(own, _paths([*count[lo:hi].tolist(), hi - lo]), strict=True):
            size[code * 257 + byte], start[code * 257 + byte] = len(path), len(nodes)
            nodes += [n for n, _ in path]
            bits += [b for _, b in path]
    pair_size = np.array(pair_size)
    return Code(np.array(nodes, np.int16), np.array(bits, np.int8), place, start, size, np.cumsum(pair_size) - pair_size, pair_size)


def triples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (two bytes before, byte) in order, and how often each came."""
    data, sizes = joined(texts)
    triple, n = np.unique((windows(data, sizes) & 0xFFFFFF).astype(np.int32), return_counts=True)
    return triple.astype(np.int64), n


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and the sums of their counts, of several such lists."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return number, np.bincount(where, np.concatenate([p[1] for p in parts]), len(number)).astype(np.int64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with EDGE behind, and the lengths including that."""
    data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    return data, np.array([len(t) + 1 for t in texts], np.int64)


def windows(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The four bytes before each byte and the byte itself, as numbers of 40 bits; before the start of a text there is EDGE."""
    held = np.concatenate([np.full(4, EDGE, np.uint8), data, np.zeros(3, np.uint8)])
    out = np.ndarray(len(data), "<u8", held, strides=(1,)).astype(np.uint64)
    out.byteswap(True)
    out >>= np.uint64(24)
    out = out.view(np.int64)
    first = np.cumsum(sizes) - sizes
    for k in range(4):
        first = first[sizes > k] if k else first
        sizes = sizes[sizes > k] if k else sizes
        out[first + k] |= (1 << 40) - (1 << 8 * (k + 1))
    return out


def _scrambled(c: np.ndarray) -> np.ndarray:
    """Other numbers of 32 bits, evenly spread, for such numbers; no two have the same."""
    c = c * SCRAMBLE & LOW
    return (c ^ c >> 16) * SCRAMBLE & LOW


def near_keys(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of bytes after the last three and the last four bytes."""
    near = window & 0xFFFFFF
    return _scrambled(window >> 8 & 0xFFFFFF) << 28 | near, _scrambled(window >> 8) << 28 | near


def windows_of(key: np.ndarray) -> np.ndarray:
    """The windows of keys after the last four bytes."""
    c = (key >> 28) * UNSCRAMBLE & LOW
    return ((c ^ c >> 16) * UNSCRAMBLE & LOW) << 8 | key & 0xFF


def _word_keys(word: np.ndarray, window: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        c = (word + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        c = (c ^ (c >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(28)
    return c.astype(np.int64) << 24 | window & 0xFFFFFF


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = np.full(n, ODD), np.full(n, INVERSE)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(inverse, out=inverse)
    return power, inverse


def word_keys(data: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The key of each byte after its word so far."""
    out, at = np.empty(len(data), np.int64), 0
    # Whole words, some WINDOW bytes at a time.
    ends = np.flatnonzero(GAP[data]) + 1
    cuts = np.unique(np.searchsorted(ends, np.arange(WINDOW, len(data), WINDOW)))
    for till in [*ends[cuts[cuts < len(ends)]].tolist(), len(data)]:
        own, n = data[at:till], till - at
        power, inverse = _powers(1 << max(WINDOW, n).bit_length())
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(NUMBER[own] * inverse[:n], out=total[1:])
            new = np.zeros(n, np.int64)
            new[1:] = np.where(GAP[own[:-1]], np.arange(1, n), 0)
            out[at:till] = _word_keys((total[:-1] - total[np.maximum.accumulate(new)]) * power[:n], window[at:till])
        at = till
    return out


def opening(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are of the first or second byte of a word or of what ends it, and their word's keys, which need no more than these."""
    one, two = window >> 8 & 0xFF, window >> 16 & 0xFF
    at = np.flatnonzero(GAP[one] | GAP[two])
    with np.errstate(over="ignore"):
        word = np.where(GAP[one[at]], np.uint64(0), NUMBER[one[at]] * ODD)
    return at, _word_keys(word, window[at])


def gates(window: np.ndarray) -> np.ndarray:
    """The set of weights for each byte: how many bytes of its word came before, GATES - 1 at most."""
    out, inside = np.zeros(len(window), np.int64), np.ones(len(window), bool)
    for k in range(1, GATES):
        inside &= ~GAP[window >> 8 * k & 0xFF]
        out += inside
    return out


def keys(data: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each context the key of each byte in it: 36 bits for the context, the two bytes before, the byte."""
    window = windows(data, sizes)
    three, four = near_keys(window)
    return [three, word_keys(data, window), four]


@dataclass
class Units:
    """The distinct words of texts, each with the blank or EDGE behind it: their bytes, and where each begins and the last ends."""

    data: np.ndarray
    edges: np.ndarray

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes are the third of a unit or later, and the keys of these after their words so far, which no other unit bears on."""
        keep = np.ones(len(self.data), bool)
        for k in range(2):
            keep[np.minimum(self.edges[:-1] + k, self.edges[1:] - 1)[np.diff(self.edges) > k]] = False
        at = np.flatnonzero(keep)
        return at, word_keys(self.data, windows(self.data, np.array([len(self.data)])))[at] if len(at) else at


    def joined(self, number: np.ndarray) -> np.ndarray:
        """The bytes of texts that are these units, one after the other."""
        first, size = self.edges[:-1], np.diff(self.edges)
        runs = np.unique(np.append(np.arange(0, len(number), WINDOW), len(number)))
        return np.concatenate([self.data[:0], *[self.data[flat(first[n], size[n])] for n in (number[a:b] for a, b in zip(runs[:-1], runs[1:], strict=True))]])


def text_sizes(data: np.ndarray) -> np.ndarray:
    """The lengths of joined texts, each with its EDGE."""
    return np.diff(np.flatnonzero(data == EDGE), prepend=-1)


def _encoded(parts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    found = parts.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


def as_units(data: np.ndarray) -> pa.Array:
    """Joined texts or units cut into units, as they come."""
    edges = np.concatenate([[0], np.flatnonzero(GAP[data]) + 1])
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])


def units(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units of joined texts, the number of each that is there, in their order, and where these begin."""
    held = as_units(data)
    return *_encoded(held), np.frombuffer(held.buffers()[1], np.int64)[:-1]


def unit_bytes(found: pa.Array) -> Units:
    _, edges, data = found.buffers()
    edges = np.frombuffer(edges, np.int64)[found.offset : found.offset + len(found) + 1]
    return Units(np.frombuffer(data, np.uint8)[edges[0] : edges[-1]], edges - edges[0])


class UnitCounts:
    """The distinct units of all texts given, and how often each came in those that are trained on."""

    #: Runs that are put together at once.
    RUNS = 16

    def __init__(self) -> None:
        self.runs: list[tuple[pa.Array, np.ndarray]] = []

    def add(self, data: np.ndarray, flags: np.ndarray) -> None:
        """``flags``: for each byte whether it is trained on."""
        found, number, first = units(data)
        self.put(found, np.bincount(number, flags[first], len(found)))

    def put(self, found: pa.Array, times: np.ndarray) -> None:
        self.runs.append((found, times.astype(np.int64)))
        if len(self.runs) > self.RUNS:
            self.runs = [self.of()]

    def of(self) -> tuple[pa.Array, np.ndarray]:
        if not self.runs:
            return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        if len(self.runs) == 1:
            return self.runs[0]
        found, number = _encoded(pa.chunked_array([r[0] for r in self.runs]))
        return found, np.bincount(number, np.concatenate([r[1] for r in self.runs]), len(found)).astype(np.int64)


def distinct(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs or the sum of its counts."""
    if count is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        key, count = key[order], count[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.diff(np.append(starts, len(key))) if count is None else np.add.reduceat(count, starts) if len(key) else count


class KeyCounts:
    """The keys of all texts given, and how often each came in those that are trained on.

    What is sorted and counted are windows, as soon as there are ``RUN`` bytes of them, and whole words: the keys
    are made of the distinct ones.
    """

    RUN = 1 << 20

    def __init__(self) -> None:
        self.waiting: list[tuple[list[bytes], np.ndarray]] = []
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []
        self.units = UnitCounts()
        self.held = 0

    def add(self, texts: list[bytes], trains: np.ndarray) -> None:
        self.waiting.append((texts, trains))
        self.held += sum(map(len, texts)) + len(texts)
        if self.held >= self.RUN:
            self._count()

    def _count(self) -> None:
        texts, trains = [t for own, _ in self.waiting for t in own], [f for _, f in self.waiting]
        self.waiting, self.held = [], 0
        if texts:
            data, sizes = joined(texts)
            flags = np.repeat(np.concatenate(trains).astype(np.int64), sizes)
            self.units.add(data, flags)
            self.near(data, flags)

    def near(self, data: np.ndarray, flags: np.ndarray) -> None:
        """Windows of some whole texts, whose units are given apart."""
        key = windows(data, text_sizes(data)) << 1 | flags
        key.sort()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1]))
        self.counted.append((key[starts] >> 1, np.add.reduceat(key & 1, starts)))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys in order and their counts."""
        self._count()
        if len(self.counted) > 1:
            self.counted = [distinct(*(np.concatenate(c) for c in zip(*self.counted, strict=True)))]
        if not self.counted:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        window, count = self.counted[0]
        if k != 1:
            return distinct(near_keys(window)[k // 2], count)
        found, times = self.units.of()
        own = unit_bytes(found)
        (first, early), (rest, late) = opening(window), own.rest()
        late_count = np.repeat(times, np.diff(own.edges))[rest]
        parts = []
        # One sixteenth of all keys after the other: sorting takes several times the room of what is sorted.
        for part in range(16):
            x, y = (np.flatnonzero(key >> KEY_BITS - 4 == part) for key in (early, late))
            parts.append(distinct(np.concatenate([early[x], late[y]]), np.concatenate([count[first[x]], late_count[y]])))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def restored(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def packed(values: np.ndarray) -> bytes:
    """Compressed, the first bytes of all values before the second ones."""
    return squeezed(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(restored(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def answers(code: Code, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct keys in order, with whole contexts: where each key's bits start, how many there are, and what is said of all bits, in steps."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] >> 8 != key[:-1] >> 8])) if len(key) else key
    sizes, every = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
    # Whole contexts, some ``ANSWERED`` keys at a time: bits take many times the room of keys.
    at = np.unique(np.searchsorted(first, np.arange(0, len(key), ANSWERED)))
    cuts = first[at[at < len(first)]]
    for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=True):
        own, times = key[lo:hi], count[lo:hi]
        size, at = code.paths(own >> 8 & 0xFFFF, own & 0xFF)
        context = np.cumsum(np.concatenate([[0], own[1:] >> 8 != own[:-1] >> 8]))
        node, where = np.unique(np.repeat(context, size) * 512 + code.nodes[at], return_inverse=True)
        many = np.repeat(times, size)
        n = np.bincount(where, many, len(node))
        ones = np.bincount(where, many * code.bits[at], len(node))
        sizes.append(size)
        every.append(np.rint(opinions(n, ones) * STEPS).clip(-127, 127).astype(np.int8)[where])
    size = np.concatenate(sizes)
    return np.cumsum(size) - size, size, np.concatenate(every)


class Places:
    """Finds what goes with distinct keys: tables that hold what had no room in the one before."""

    def __init__(self, key: np.ndarray, value: np.ndarray, shift: int = 0):
        """``key``: with ``shift`` bits below that are no part of it, but found with it."""
        self.shift, self.tables = shift, []
        left, odd = np.stack([key, value], 1).view(np.complex128).ravel(), int(ODD)  # 16 bytes that lie together
        while len(left):
            bits = int(len(left)).bit_length()
            table = np.full(2 << bits, -1, np.int64).view(np.complex128)
            at = self._at(left.view(np.int64)[::2] >> shift, odd, bits)
            table[at] = left
            self.tables.append((odd, bits, table))
            left = left[table[at].view(np.int64)[::2] != left.view(np.int64)[::2]]
            odd = (odd * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    @staticmethod
    def _at(key: np.ndarray, odd: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = key.view(np.uint64) * np.uint64(odd)
            x >>= np.uint64(64 - bits)
            return x.view(np.int64)

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys with their lower bits, and the values."""
        out, todo = None, np.zeros(0, np.int64)
        for odd, bits, table in self.tables:
            own = key if out is None else key[todo]
            got = table.take(self._at(own, odd, bits), mode="clip")
            miss = np.flatnonzero(got.view(np.int64)[::2] >> self.shift != own)
            if out is None:
                out, todo = got, miss
            else:
                out[todo] = got
                todo = todo[miss]
            if not len(todo):
                break
        if out is None and len(key) or len(todo):
            raise KeyError("a key that was not counted")
        out = np.zeros(0, np.int64) if out is None else out.view(np.int64)
        return out[::2], out[1::2]


def opinions(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The gated logarithm of the odds of each slot."""
    return (np.log((ones + 0.3) / (n - ones + 0.3)) * (n / (n + 0.4))).astype(np.float32)


class Known:
    """What the answers of keys say of the bits of some texts that have only such keys.

    All is said against the other bit than the one that came. The last four bytes and the byte, its window, fix
    what comes of the last three as well, the byte's bits, and what comes of a word's first bytes.
    """

    def __init__(self, code: Code, tables: list[tuple[np.ndarray, np.ndarray]], texts: list[bytes]):
        """``tables``: for each context the distinct keys in order, and what is said of all their bits."""
        (three, of_three), (word, of_word), (four, of_four) = tables
        self.of_word, start, _ = signed(code, word, of_word)
        self.word = Places(word, start)
        near, place, size = signed(code, four, of_four)
        window = windows_of(four)
        own, start, _ = signed(code, three, of_three)
        own = own[flat(start[np.searchsorted(three, near_keys(window)[0])], size)]
        self.near = np.stack([own, near], 1).view(np.int16).ravel()
        place <<= 32
        at, key = opening(window)
        place[at] |= self.word(key)[1]
        self.window = Places(window << 16 | size << 2 | gates(window), place, 16)
        self.meet(texts)

    def meet(self, texts: list[bytes]) -> None:
        """From now on it is about these texts."""
        found, number, _ = units(joined(texts)[0])
        self.know(unit_bytes(found))
        self.read(number)

    def know(self, own: Units) -> None:
        """The texts to come are of these units."""
        self.units, self.starts = own, np.zeros(len(own.data), np.int32)  # of a unit's first two bytes the window says it
        # Units of some WINDOW bytes at a time.
        cuts = np.unique(np.append(np.searchsorted(own.edges, np.arange(0, len(own.data), WINDOW)), len(own.edges) - 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lo, hi = own.edges[a], own.edges[b]
            rest, key = Units(own.data[lo:hi], own.edges[a : b + 1] - lo).rest()
            self.starts[lo + rest] = self.word(key)[1]

    def read(self, number: np.ndarray) -> np.ndarray:
        """From now on it is about the texts that are these units one after the other; they are returned, joined."""
        data, edges = self.units.joined(number), self.units.edges
        #: Of each byte where what is said of its bits begins, of near bytes and, below, of the word, and how many bits it has with, below, its set of weights.
        self.place, self.kind = np.zeros(len(data), np.int64), np.zeros(len(data), np.uint16)
        window, at = windows(data, text_sizes(data)), 0
        runs = np.unique(np.append(np.arange(0, len(number), WINDOW >> 2), len(number)))
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            own = number[a:b]
            inside = self.starts[flat(edges[:-1][own], edges[1:][own] - edges[:-1][own])]
            till = at + len(inside)
            kind, place = self.window(window[at:till])
            self.kind[at:till] = kind & 0xFFFF
            np.add(place, inside, out=self.place[at:till])
            at = till
        return data

    def said(self, row: np.ndarray, size: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each context: what it says, in steps, of each bit of the bytes in these rows."""
        out, first, place = np.empty((ORDERS, ends[-1]), np.float32), ends - size, self.place[row]
        at = spread(place, size, first, 1 << 32 | 1)  # both at once
        near = self.near.take(at >> 32, mode="clip").view(np.int8)
        out[0], out[2] = near[::2], near[1::2]
        at &= LOW
        out[1] = self.of_word.take(at, mode="clip")
        return out


def signed(code: Code, key: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is said against the other bit than the one that came, for keys; where each one's begins, and how many bits it has."""
    out, sizes = said.copy(), np.zeros(len(key), np.int64)
    at = 0
    for i in range(0, len(key), ANSWERED):
        own = key[i : i + ANSWERED]
        sizes[i : i + ANSWERED], path = code.paths(own >> 8 & 0xFFFF, own & 0xFF)
        out[at : at + len(path)] *= 1 - 2 * code.bits[path]
        at += len(path)
    return out, np.cumsum(sizes) - sizes, sizes


def spread(value: np.ndarray, size: np.ndarray, first: np.ndarray, step: int) -> np.ndarray:
    """As many numbers as each size, which begin with the value and grow by step; first is where they begin."""
    out = np.full(first[-1] + size[-1], step)
    out[first[0]] = value[0]
    out[first[1:]] = value[1:] - value[:-1] - (size[:-1] - 1) * step
    return np.cumsum(out, out=out)


def batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= WINDOW:
            yield part
            part, size = [], 0
    if part:
        yield part


def stretches(most: int) -> np.ndarray:
    """Where the weights' refinements lie in a text of ``most`` bytes: 0, the end of each stretch, ``most``."""
    out, at = [0], 0
    while at < most:
        at = min(most, at + max(1, at // EACH))
        out.append(at)
    return np.array(out)


def score(code: Code, model: Known, texts: list[bytes]) -> np.ndarray:
    """The natural logarithm of each text's probability, its end included. ``model`` is about these texts.

    All texts go forward together, stretch by stretch; each one's weights follow its own errors.
    """
    data, sizes = joined(texts)
    if not len(data):
        return np.zeros(0)
    order = np.argsort(-sizes, kind="stable")
    long, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
    n = len(long)
    edges = stretches(int(long[0]))
    active = n - np.searchsorted(long[::-1], edges[:-1], "right")  # texts with a byte in each stretch
    total = np.zeros(n * GATES)
    weights = np.repeat(FIRST[:, None] / STEPS, n * GATES, 1)  # what is said is in steps
    upto = np.concatenate([[0], np.cumsum(long[::-1])])  # bytes of the shortest texts
    ends = upto[n - active] + active * edges[:-1]  # bytes of all texts before each stretch
    at, last = 0, len(edges) - 1
    while at < last:
        till = min(last, max(at + 1, int(np.searchsorted(ends, ends[at] + WINDOW, "right")) - 1))
        many = active[at:till]
        who = flat(np.zeros(len(many), np.int64), many)
        first, stop = np.repeat(edges[at:till], many), np.repeat(edges[at + 1 : till + 1], many)
        count = np.minimum(long[who], stop) - first
        row = flat(start[who] + first, count)
        text = np.repeat(who, count)
        kind = model.kind[row].astype(np.int64)
        size = kind >> 2
        bits = np.cumsum(size)
        said = model.said(row, size, bits)
        of_bit = spread(text * GATES + (kind & GATES - 1), size, bits - size, 0)
        wrong = np.empty(len(of_bit), np.float32)
        # Where each stretch's bits end.
        cuts = bits[np.cumsum(count)[np.cumsum(many) - 1] - 1].tolist()
        b = 0
        for a, e, width in zip((many * GATES).tolist(), cuts, np.diff(edges[at : till + 1]).tolist(), strict=True):
            own, mine, odds = said[:, b:e], of_bit[b:e], wrong[b:e]
            np.multiply(weights[0].take(mine, mode="clip"), own[0], out=odds)
            for w, o in zip(weights[1:], own[1:], strict=True):
                odds += w.take(mine, mode="clip") * o
            np.minimum(np.maximum(odds, -11, out=odds), 11, out=odds)
            np.exp(odds, out=odds)
            own *= odds / (1 + odds)
            rate = RATE * min(1, MOST / width) / STEPS**2
            for w, o in zip(weights, own, strict=True):
                w[:a] -= rate * np.bincount(mine, o, a)
            b = e
        one = 1 + wrong
        wrong *= np.log(one) / (one - 1)  # log1p, by what got lost in the sum
        total -= np.bincount(of_bit, wrong, n * GATES)
        at = till
    out = np.empty(n)
    out[order] = total.reshape(n, GATES).sum(1)
    return out
