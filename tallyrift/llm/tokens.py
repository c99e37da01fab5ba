"""Token ids of whole texts, word by word: a word is encoded once and remembered.

Natural text repeats its words, so the ids of most are found in a table that each Python worker
keeps between tasks, ``WORDS_CHARS`` characters of words at most and none longer than ``LONGEST``. That is exact for tokenizers that encode each word
on its own, if words are told apart as the tokenizer does; ``WordEncoder`` knows how
``word_bpe_49k.json`` does it for texts of Latin letters, signs and digits. All other texts, and
other tokenizers, are encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

WORDS_CHARS, LONGEST = 3_000_000, 64
#: What the tokenizer file must say for its words to be told apart by ``WORD``.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below U+0180 nothing composes, so NFC changes nothing there; U+0130 grows when lower-cased.
OTHER = re.compile("[^\x00-įı-ſ]")
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[^\t-\r \x85\xa0{LETTERS}{NUMBERS}]+")


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        steps = (said.get("normalizer") or {}).get("normalizers", [])
        split = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {})
        suffix = said["model"].get("end_of_word_suffix")
        self.by_word = [x["type"] for x in steps] == NORMALIZERS and split.get("Regex") == SPLIT and bool(suffix)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in said.get("added_tokens", [])) or "(?!)")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of new words, one call for all: each ends with the token that has the end-of-word suffix.

        Where the library ends another number of words, each is encoded by itself.
        """
        order = list(words)
        ids = np.array(self.tokenizer.encode(" ".join(order), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(order):
            return {w: np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in order}
        cut = np.append(0, ends * 4).tolist()
        raw = ids.tobytes()
        return {w: raw[lo:hi] for w, lo, hi in zip(order, cut[:-1], cut[1:], strict=True)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        split: dict[int, list[str]] = {}
        whole = []
        for i, t in enumerate(texts):
            if t:
                if self.by_word and not OTHER.search(t) and not self.special.search(t):
                    split[i] = WORD.findall(t.lower())
                else:
                    whole.append(i)
        if self.held > WORDS_CHARS:
            self.known.clear()
            self.held = 0
        new: set[str] = set()
        for words in split.values():
            new.update(words)
        new.difference_update(self.known)
        learned = self._learn(new) if new else {}
        self.known |= learned
        get = self.known.__getitem__
        for i, words in split.items():
            out[i] = b"".join(map(get, words))
        for w in learned:
            if len(w) > LONGEST:
                del self.known[w]
            else:
                self.held += len(w) + 8
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out


@lru_cache(4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
