import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrift.llm import bytemix, lmscore
from tallyrift.llm.lmscore import block_rows, lm_scores, tokens


def texts(n=150, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    return [" ".join(r.choice(words).title() if r.random() < 0.1 else r.choice(words) for _ in range(r.randrange(80))) for _ in range(n)]


def test_base_against_brute_force(docs_of):
    every = [*texts(), None, "", "A B c\x0b\x0cD", "É é", "long " * 30000]
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    got = {r.doc_id: r for r in lm_scores(docs_of(every), ~held).collect()}
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    own = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) for t in every]
    trains = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(every))]
    count = Counter(w for i, ws in enumerate(own) if trains[i] for w in [*ws, None])
    total, distinct = sum(count.values()), len(count)
    for i, ws in enumerate(own):
        want = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*ws, None])
        r = got[i]
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.trains) == (len(ws) + 1, sum(w in count for w in [*ws, None]), total, trains[i])
        assert r.score < 0
    assert lm_scores(docs_of(["a"]).limit(0), ~held).count() == 0
    assert lm_scores(docs_of(["a b"]), F.lit(False)).first().n_known == 0


def coded(train):
    return bytemix.huffman(*bytemix.triples(train))


def known(train, others, code):
    counts = bytemix.KeyCounts()
    counts.add(train, np.ones(len(train), bool))
    counts.add(others, np.zeros(len(others), bool))
    every = [counts.of(k) for k in range(bytemix.ORDERS)]
    return every, bytemix.Known(code, [(key, bytemix.answers(code, key, n)[2]) for key, n in every], others)


def scored(train, others):
    code = coded(train)
    return bytemix.score(code, known(train, others, code)[1], others)


def slow_score(train, text):
    """The model again, a bit at a time, with dictionaries for its counts."""
    code = coded(train)

    def contexts(b):
        """Of each byte and the end: its contexts, the byte before and the set of weights."""
        out, word = [], b""
        for i in range(len(b) + 1):
            last = b"\xff" * 4 + b[:i]
            out.append(((last[-3:], (last[-2:], word), last[-4:]), last[-1] | last[-2] << 8, min(len(word), bytemix.GATES - 1)))
            if i < len(b):
                word = b"" if b[i] == 32 or 9 <= b[i] <= 13 else word + b[i : i + 1].lower()
        return out

    def bits(before, byte):
        at = code.paths(np.array([before]), np.array([byte]))[1]
        return zip(code.nodes[at].tolist(), code.bits[at].tolist(), strict=True)

    seen, ones = Counter(), Counter()
    for t in train:
        for (own, before, _), byte in zip(contexts(t), t + b"\xff", strict=True):
            for node, bit in bits(before, byte):
                for k, c in enumerate(own):
                    seen[k, c, node] += 1
                    ones[k, c, node] += bit
    total, weights = 0.0, np.repeat(bytemix.FIRST[None].astype(float), bytemix.GATES, 0)
    step, at, width = np.zeros_like(weights), 0, 1
    for i, ((own, before, gate), byte) in enumerate(zip(contexts(text), text + b"\xff", strict=True)):
        for node, bit in bits(before, byte):
            say = []
            for k, c in enumerate(own):
                n, o = seen[k, c, node], ones[k, c, node]
                say.append(round(math.log((o + 0.3) / (n - o + 0.3)) * n / (n + 0.4) * bytemix.STEPS) / bytemix.STEPS)
            say = np.array(say)
            p = 1 / (1 + math.exp(-max(-11, min(11, float(weights[gate] @ say)))))
            total += math.log(p if bit else 1 - p)
            step[gate] += (bit - p) * say
        if i + 1 == at + width:  # the end of a stretch
            weights += bytemix.RATE * min(1, bytemix.MOST / width) * step
            step[:] = 0
            at += width
            width = max(1, at // bytemix.EACH)
    return total


def test_score_equals_the_slow_model(monkeypatch):
    monkeypatch.setattr(bytemix, "EACH", 20)  # so that stretches grow soon
    monkeypatch.setattr(bytemix, "MOST", 3)
    train = [t.encode() for t in texts(120)]
    others = [b"", b"ab Cd", train[3], train[4] + b" new words \xc3\xa9 1", b"zzz zz", train[5][:51]]
    others.append(b" ".join(train[6:12]))
    assert np.diff(bytemix.stretches(len(others[-1]))).max() > 2 * bytemix.MOST
    assert scored(train, others) == pytest.approx([slow_score(train, t) for t in others], rel=1e-4, abs=1e-3)


def test_stretches_go_by_the_place_alone():
    assert bytemix.stretches(0).tolist() == [0]
    long = bytemix.stretches(10**7)
    assert long[-1] == 10**7 and len(long) < bytemix.EACH * (2 + math.log(10**7 / bytemix.EACH))
    for n in (1, bytemix.EACH, 5000, 99_999):
        own = bytemix.stretches(n)
        assert own[-1] == n and (own[:-1] == long[: len(own) - 1]).all()


def test_weights_are_kept_along_long_texts(monkeypatch):
    monkeypatch.setattr(bytemix, "FIRST", np.array([0.02, 0.02, 0.02], np.float32))  # so that there is much to learn
    train = [t.encode() for t in texts(400)]
    whole = b" ".join(train)
    assert len(whole) > 30_000
    at = len(whole) // 2
    half, every = -scored(train, [whole[:at], whole])
    pieces = [whole[i : i + 200] for i in range(at, len(whole) - 200, 200)]
    # What was learned serves a text to its end; its pieces, each from anew, cost more.
    assert (every - half) / (len(whole) - at) < 0.9 * -scored(train, pieces).sum() / sum(map(len, pieces))


def test_answers_are_the_same_in_parts(monkeypatch):
    train = [t.encode() for t in texts(60)]
    code = coded(train)
    counts = bytemix.KeyCounts()
    monkeypatch.setattr(bytemix.KeyCounts, "RUN", 500)
    for at in lmscore._runs(train, 200):
        counts.add(train[at], np.ones(len(train[at]), bool))
    every, _ = known(train, [], code)
    for k, (key, n) in enumerate(every):
        assert all((a == b).all() for a, b in zip(counts.of(k), (key, n), strict=True))
        whole = bytemix.answers(code, key, n)
        monkeypatch.setattr(bytemix, "ANSWERED", 7)
        assert all((a == b).all() for a, b in zip(bytemix.answers(code, key, n), whole, strict=True))
        monkeypatch.undo()
        monkeypatch.setattr(bytemix.KeyCounts, "RUN", 500)


def test_probabilities_add_up_and_training_helps():
    train = [t.encode() for t in texts(300)]
    code = coded(train)
    # After any prefix the next byte's probabilities are those of its bits, so all one-byte texts and the empty one
    # have a total probability below one; below, not one, as an escape may be followed by a byte that needs none.
    ends = scored(train, [bytes([i]) for i in range(255)] + [b""])
    assert 0 < np.exp(ends).sum() < 1 + 1e-6
    for two in (0xFFFF, 97 | 98 << 8, 32 | 97 << 8, 7 | 7 << 8):
        size, _ = code.paths(np.full(256, two), np.arange(256))
        assert 0.5 < (2.0 ** -size).sum() < 1 + 1e-9
    own = texts(20, 3)
    noise = ["".join(random.Random(i).sample(t, len(t))) for i, t in enumerate(own)]
    size = sum(len(t.encode()) for t in own)
    bits = lambda ts: -scored(train, [t.encode() for t in ts]).sum() / math.log(2) / size
    assert bits(own) < 0.7 * bits(noise) and bits(own) < 2.5


def test_texts_are_scored_on_their_own():
    train = [t.encode() for t in texts(100)]
    some = [b"", b"abc de", train[0] * 30, b"x" * 9000, train[5]]
    assert np.allclose(scored(train, some), np.concatenate([scored(train, [t]) for t in some]), rtol=1e-4)


def test_packed_rows_come_back():
    own = [b"b\xc3\xa9 a", b"", b"a a " * 5, b"x"]
    rows = list(block_rows(own, [1, 2, 3, 4], [True, False, True, True], 2))
    packed = [r for r in rows if r[0] == lmscore.TEXTS]
    assert [t for r in packed for t in lmscore.unpack_texts(r[2], r[3])] == own and [i for r in packed for i in r[4]] == [1, 2, 3, 4]
    words = {w: n for r in rows if r[0] == lmscore.WORDS for w, n in zip(lmscore.unpack_words(r[2]), bytemix.unpacked(r[3], np.int32).tolist(), strict=True)}
    assert words == {b"": 3, b"a": 11, b"b\xc3\xa9": 1, b"x": 1}


def test_ids_of_other_kinds_and_repeated_rows(spark):
    docs = spark.createDataFrame([("a", "one two"), ("a", "one two"), (None, "three"), ("b", None)], "doc_id string, text string").repartition(3)
    got = lm_scores(docs, F.lit(True)).collect()
    assert sorted(r.doc_id or "" for r in got) == ["", "a", "a", "b"] and len({r.score for r in got if r.doc_id == "a"}) == 1
    assert {r.train_tokens for r in got} == {9}


def test_tokens():
    assert tokens("AÄb\x1cC d e".encode()) == ["aÄb\x1cc".encode(), "d e".encode()]


def test_no_context_shares_its_counts():
    r = random.Random(8)
    train = [bytes(r.choices(range(32, 127), k=4000)) for _ in range(30)]  # more contexts than 2^16 slots
    code = coded(train)
    every, _ = known(train, train[:2], code)
    three = Counter(b[i : i + 4] for t in train for b in [b"\xff" * 3 + t + b"\xff"] for i in range(len(t) + 1))
    key, n = every[0]
    assert len(key) == len(three) and sorted(n.tolist()) == sorted(three.values())
    size, at = code.paths(key >> 8 & 0xFFFF, key & 0xFF)
    own, paths, bits = Counter(), {}, lambda b: code.paths(np.array([b[2] | b[1] << 8]), np.array([b[3]]))[1]
    for b, c in three.items():  # bits by (context, node), as exact keys give them
        paths[b] = bits(b)
        for i in paths[b]:
            own[b[:3], int(code.nodes[i]), int(code.bits[i])] += c
    want = [float(bytemix.opinions(np.float64(own[b[:3], m, 0] + own[b[:3], m, 1]), np.float64(own[b[:3], m, 1]))) for b in three for m in code.nodes[paths[b]].tolist()]
    assert np.allclose(np.sort(bytemix.answers(code, key, n)[2]) / bytemix.STEPS, np.clip(np.sort(want), -15.875, 15.875), atol=0.51 / bytemix.STEPS)
    assert len(at) == size.sum() == len(want)


def test_weights_follow_each_byte(monkeypatch):
    train = [t.encode() for t in texts(100)]
    short = [t[:300] for t in train if len(t) > 60]
    moved = scored(train, short)
    monkeypatch.setattr(bytemix, "RATE", 0.0)
    assert (np.abs(scored(train, short) - moved) > 1e-6).all()


def test_last_three_and_four_bytes_and_the_word_are_contexts():
    data, sizes = bytemix.joined([b"abcdX", b"zbcdX", b"zacdX"])
    assert bytemix.ORDERS == 3 and len(bytemix.keys(data, sizes)) == 3
    same = [len(np.unique(k[[4, 10]])) for k in bytemix.keys(data, sizes)]
    assert same == [1, 2, 2]  # the last three agree, words and last four don't


def test_distinct_words_are_looked_up_once(monkeypatch):
    train = [t.encode() for t in texts(20)] * 20
    looked, find = [], bytemix.Places.__call__
    monkeypatch.setattr(bytemix.Places, "__call__", lambda self, key: looked.append(len(key)) or find(self, key))
    assert len(set(scored(train, train).round(6))) <= 20
    assert sum(looked) < 1.5 * sum(len(t) + 1 for t in train)  # a byte's window; not each of its contexts


def test_units_and_windows_come_back():
    own = [b"", b" ", b"a  b\n", b"word", b"\x00\xfe A a", b"word word", b"\xf0\x9f\x98\x80 x" * 3]
    data, sizes = bytemix.joined(own)
    found, number, first = bytemix.units(data)
    units = bytemix.unit_bytes(found)
    assert units.joined(number).tobytes() == data.tobytes() and bytemix.text_sizes(data).tolist() == sizes.tolist()
    assert lmscore.unpack_texts(*lmscore.pack_units(found, number)) == own
    at = lmscore.text_runs(found, number)
    assert first[at[:-1]].tolist() == (np.cumsum(sizes) - sizes).tolist() and at[-1] == len(number)
    window = bytemix.windows(data, sizes)
    want = [int.from_bytes((b"\xff" * 4 + t + b"\xff")[i : i + 5], "big") for t in own for i in range(len(t) + 1)]
    assert window.tolist() == want and bytemix.windows_of(bytemix.near_keys(window)[1]).tolist() == want
    # A byte's key after its word is the same from its window, or from its unit alone.
    word, (early, key), (rest, late) = bytemix.keys(data, sizes)[1], bytemix.opening(window), units.rest()
    assert (word[early] == key).all()
    place = bytemix.flat(units.edges[:-1][number], np.diff(units.edges)[number])
    of = dict(zip(rest.tolist(), late.tolist(), strict=True))
    assert all(of[p] == w for i, (p, w) in enumerate(zip(place.tolist(), word.tolist(), strict=True)) if i not in set(early.tolist()))
