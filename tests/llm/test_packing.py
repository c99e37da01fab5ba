import random
import zlib
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrift.llm import packing
from tallyrift.llm.tokens import WordEncoder, encoder


def test_pieces_and_places(docs_of, tokenizer):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    r = random.Random(1)
    texts = [" ".join(r.choice(["the", "Quick", "brown.", "fox's", "ünï", "12"]) for _ in range(r.randrange(0, 400))) for _ in range(120)]
    texts += [None, "", "word " * 9000, "中文 İ <|endoftext|> a", *["same length"] * 60]
    got = packing.pack(docs_of(texts), path, 256).toPandas()
    enc, want = Tokenizer.from_file(path), []
    for i, t in enumerate(texts):
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    got = got.sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id").length
    assert (by.cumsum() - got.length == got.offset).all() and by.sum().max() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 2
    ids = packing.pack(docs_of(texts[:5]), path, 256, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in ids)
    again = packing.pack(docs_of(["a b"] * 30 + [None] * 3, [1] * 33), path, 256, with_ids=True).collect()  # repeated rows
    assert len(again) == 33 and len({(r.sequence_id, r.offset) for r in again}) == 33 and {len(r.ids) for r in again} == {3, 1}
    assert packing.pack(docs_of(["a"]).limit(0), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_uses_all_and_fits(counts):
    made, used = packing.plan(counts, 32), {}
    for row, times in made:
        assert sum(row) <= 32 and times > 0
        for x in row:
            used[x] = used.get(x, 0) + times
    assert used == counts
    # Best fit: no two sequences could be one.
    loads = sorted(sum(row) for row, times in made for _ in range(min(times, 2)))
    assert len(loads) < 2 or loads[0] + loads[1] > 32


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=25, max_size=25))
def test_sums_find_what_is_there(have):
    have = np.array([0, *have[1:]])
    sums = packing.Sums(have)
    for _ in range(3):
        for gap in range(1, len(have)):
            way = sums.fill(have, gap)
            lengths = [x for x in range(1, gap + 1) for _ in range(have[x])]
            there = any(sum(c) == gap for n in (1, 2, 3) for c in set(combinations(lengths, n)))
            assert (way is not None) == there
            assert way is None or (sum(way) == gap and all(have[x] >= way.count(x) for x in way))
            if way:
                have[way[0]] -= 1


def test_plan_is_optimal_where_complements_are():
    assert sum(t for _, t in packing.plan({20: 7, 12: 7}, 32)) == 7
    assert sum(t for _, t in packing.plan({16: 3, 10: 3, 4: 3, 2: 3}, 32)) == 3


def test_words_are_the_tokenizers(tokenizer):
    enc: WordEncoder = encoder(tokenizer("word_bpe_49k.json"))
    r = random.Random(4)
    alphabet = [chr(i) for i in range(1, 0x180)] + list("'''sstm redl ") * 5 + ["̀", "中", " "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.by_word and enc.encode(texts) == want
