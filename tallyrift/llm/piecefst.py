"""SentencePiece encoding and decoding by a weighted transducer and its shortest path.

Three machines are composed with each input. The normaliser is a transducer compiled from the model: its
character map as a trie whose longest match is rewritten, user-defined pieces passed as they are, blanks
put in front, joined or dropped at the ends as the model says, and written as U+2581. The pieces are a trie
whose final states write a piece's id. The byte fallback writes the bytes of a character that no piece has;
without it a run of such characters is one unknown id. A state of the result is a position and the piece
that ended there; the shortest path in the tropical semiring (least sum of weights) is the encoding.

In a unigram model a piece weighs its negative score, a user-defined one next to nothing, a character without a piece ten more than the worst; sums have single precision
and the first of equal paths stays, as in the library. In a BPE model weights alone don't say what
merging gives, so the machine has its constraint in the transitions: a piece may follow another only
if merging the two pieces' text gives just those two. A sequence is what merging gives if and only if
that holds for all neighbours, so each position keeps one state, and the path is the library's result.
Runs of blanks, whose pieces all have one score, are merged directly, leftmost first, with the word
behind them; so is a part through which the constraint leaves no path.

Inputs are cut between characters that are neighbours in no piece: before blanks, at line feeds, and
between letters and other characters, as far as the model's pieces allow. A cut-out part is encoded
once and remembered, up to ``PARTS_CHARS`` characters of parts in each worker, none of more than ``LONGEST``.

Null and empty texts have no ids. Repeated rows are encoded one by one; very long texts are read whole;
an empty table gives no rows. Ids that are null or that the model doesn't have decode to nothing. Only
the columns named are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS_CHARS, LONGEST, PAIRS = 8_000_000, 64, 400_000
BLANK = "▁"
NORMAL, USER, BYTE = 1, 4, 6


def char_map(blob: bytes) -> dict[str, str]:
    """The rewrites of a normaliser: read from its double-array trie (a size, units of 32 bits, then texts that end in a zero byte)."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    below = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    out, todo = {}, [(below(units[0]), b"")]
    while todo:
        at, key = todo.pop()
        for c in range(1, 256):
            if (at ^ c) < len(units) and units[at ^ c] & 0x800000FF == c:
                unit, word = units[at ^ c], key + bytes([c])
                nxt = (at ^ c) ^ below(unit)
                if unit >> 8 & 1:
                    start = units[nxt] & 0x7FFFFFFF
                    out[word] = texts[start : texts.index(b"\0", start)]
                todo.append((nxt, word))
    return {k.decode(): v.decode() for k, v in out.items()}


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise NotImplementedError("only models that write blanks as U+2581, before words")
        self.rewrites = char_map(spec.precompiled_charsmap)
        self.front = BLANK if spec.add_dummy_prefix else ""
        self.trim = spec.remove_extra_whitespaces
        self.unigram = model.trainer_spec.model_type == 1
        self.ids, self.score, self.byte_ids = {}, {}, [0] * 256
        self.raw: list[bytes] = []
        self.unknown = 0
        for i, p in enumerate(model.pieces):
            if p.type in (NORMAL, USER):
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.raw.append(p.piece.replace(BLANK, " ").encode())
            elif p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.raw.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.unknown = i if p.type == 2 else self.unknown
                self.raw.append(b"")
        self.bytes = model.trainer_spec.byte_fallback
        self.user = {p.piece for p in model.pieces if p.type == USER}
        best = [p.score for p in model.pieces if p.type == NORMAL]
        self.most, self.miss = np.float32(max([0.0, *best])), np.float32(min(best, default=0.0)) - np.float32(10)
        starts = sorted({*self.rewrites, *self.user}, key=lambda x: (-len(x), x))
        self.pattern = re.compile("|".join(map(re.escape, starts))) if starts else None
        self.known_chars = 0
        # The trie: each state's arcs by character, and the piece that ends there.
        self.trie: list[dict[str, int]] = [{}]
        self.final: list[str | None] = [None]
        for piece in self.ids:
            at = 0
            for c in piece:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.final.append(None)
                at = self.trie[at][c]
            self.final[at] = piece
        self.tied = self.score.get(BLANK * 2) is not None and self.score.get(BLANK * 2) == self.score.get(BLANK * 4)
        self.follows: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Where inputs may be cut: between characters that are neighbours in no piece."""
        letter = re.compile(r"[^\W\d_²³¹]")
        kind = lambda c: BLANK if c == BLANK else "\n" if c == "\n" else "a" if letter.match(c) else "-"
        met = {(kind(a), kind(b)) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        if self.user or not self.bytes or (self.unigram and not self.front) or any(a != BLANK and b == BLANK or "\n" in (a, b) for a, b in met):
            return re.compile("(?s).+")
        if ("a", "-") in met or ("-", "a") in met:
            return re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
        return re.compile(rf"{BLANK}*[^\W\d_²³¹]+|{BLANK}*(?:(?![{BLANK}\n])[\W\d_²³¹])+|{BLANK}+|\n")

    def normalise(self, text: str) -> str:
        """What the pieces are matched with: the longest match at each place is rewritten, blanks are settled."""
        if self.pattern:
            text = self.pattern.sub(lambda m: m[0] if m[0] in self.user else self.rewrites[m[0]], text)
        if self.trim:
            text = re.sub(" {2,}", " ", text).strip(" ")
        return self.front + text.replace(" ", BLANK) if text else ""

    def merge(self, text: str) -> list[str]:
        """What merging gives: the best pair first, of equal ones the leftmost."""
        part = self.symbols(text)
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and part[i] not in self.user and part[j] not in self.user and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, part[i] + part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] and (j := right[i]) < n and part[i] + part[j] == both:
                part[i], part[j] = both, ""
                right[i] = right[j]
                if right[i] < n:
                    left[right[i]] = i
                offer(i)
                if left[i] >= 0:
                    offer(left[i])
        return [p for p in part if p]

    def symbols(self, text: str) -> list[str]:
        """The characters of a text, but user-defined pieces whole: those are never merged."""
        if not self.user:
            return list(text)
        out, at = [], 0
        longest = max(map(len, self.user))
        while at < len(text):
            size = next((k for k in range(min(longest, len(text) - at), 1, -1) if text[at : at + k] in self.user), 1)
            out.append(text[at : at + size])
            at += size
        return out

    def _follows(self, a: str, b: str) -> bool:
        ok = self.follows.get((a, b))
        if ok is None:
            if len(self.follows) > PAIRS:
                self.follows.clear()
            ok = self.follows[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return ok

    def path(self, text: str) -> list[str]:
        """The pieces of the shortest path; a character that is none stands for its bytes."""
        if self.unigram:
            return self._least(text)
        if self.user or (self.tied and BLANK * 2 in text):
            return self.merge(text)
        n, trie, final = len(text), self.trie, self.final
        last: list[str | None] = [""] + [None] * n
        for i in range(n):
            if last[i] is None:
                continue
            a, state, j = last[i], 0, i
            single = False
            while j < n and (state := trie[state].get(text[j], -1)) >= 0:
                j += 1
                piece = final[state]
                if piece is not None:
                    single = single or j == i + 1
                    if last[j] is None and self._follows(a, piece):
                        last[j] = piece
            if not single and last[i + 1] is None:
                last[i + 1] = ""
        if last[n] is None:
            return self.merge(text)
        out, j = [], n
        while j > 0:
            piece = last[j] or text[j - 1]
            out.append(piece)
            j -= len(piece)
        return out[::-1]

    def _least(self, text: str) -> list[str]:
        """The path of the least weight; weights are single-precision sums of scores, the first of equal ones stays."""
        n, trie, final = len(text), self.trie, self.final
        best: list[np.float32 | None] = [np.float32(0)] + [None] * n
        last = [""] * (n + 1)
        for i in range(n):
            state, j, single = 0, i, False
            while j < n and (state := trie[state].get(text[j], -1)) >= 0:
                j += 1
                piece = final[state]
                if piece is None:
                    continue
                single = single or j == i + 1
                score = np.float32(len(piece.encode()) * self.most - 0.1) if piece in self.user else np.float32(self.score[piece])
                if best[j] is None or best[i] + score > best[j]:
                    best[j], last[j] = best[i] + score, piece
            if not single and (best[i + 1] is None or best[i] + self.miss > best[i + 1]):
                best[i + 1], last[i + 1] = best[i] + self.miss, text[i]
        out, j = [], n
        while j > 0:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def _write(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        missed = False
        for p in pieces:
            known = p in self.ids
            if known:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.byte_ids[b] for b in p.encode()]
            elif not missed:
                out.append(self.unknown)  # one for a run
            missed = not known
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self.cut.findall(self.normalise(text))
        known = self.known
        if self.known_chars > PARTS_CHARS:
            known.clear()
            self.known_chars = 0
        out = []
        for p in parts:
            own = known.get(p)
            if own is None:
                own = self._write(self.path(p))
                if len(p) <= LONGEST:
                    known[p] = own
                    self.known_chars += len(p) + 8
            out.append(own)
        return b"".join(out)

    def decode(self, ids: list[int | None]) -> str:
        """The text of ids: the inverse path, without the blank in front."""
        text = b"".join([self.raw[i] for i in ids if i is not None and 0 <= i < len(self.raw)]).decode("utf-8", "replace")
        return text[1:] if self.front and text.startswith(" ") else text


@lru_cache(4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """``id_col``, n_ids, n_bytes (ids of the byte fallback), ids_crc32, round_trip, and if wanted ids and decoded for each row.

    decoded: the text that the ids give back; round_trip: whether that is the row's own text; blanks written as U+2581 come back as blanks.
    """
    kind = next(t for n, t in docs.dtypes if n == id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        low = np.array(sorted(fst.byte_ids)) if fst.bytes else np.array([1, 0])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, n, fell, crc, same, back = [], [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    raw = fst.encode(text)
                    own = np.frombuffer(raw, "<u4")
                    n.append(len(own))
                    fell.append(int(((own >= low[0]) & (own <= low[-1])).sum()))
                    crc.append(zlib.crc32(raw))
                    decoded = fst.decode(own.tolist())
                    same.append(decoded == (text or "").replace(BLANK, " "))
                    if with_ids:
                        ids.append(own.astype(np.int64))
                    if with_text:
                        back.append(decoded)
                cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(fell, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
                names = [id_col, "n_ids", "n_bytes", "ids_crc32", "round_trip"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                if with_text:
                    cols.append(pa.array(back, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {kind}, n_ids bigint, n_bytes bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<bigint>" * with_ids + ", decoded string" * with_text
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text: the ids of each row decoded; null ids give an empty text."""
    kind = next(t for n, t in encoded.dtypes if n == id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            texts = [fst.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, f"`{id_col}` {kind}, text string")
