import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyrift.llm import registry, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]]]


def slow(docs, target, share=25, least=20):
    """Each document's n_features, weight, score, rank, one after the other; None as an id comes last."""
    of = [(i, *by_hand(t)) for i, t in docs]
    raw, goal = [0] * 10000, [0] * 10000
    for _, _, fs in of:
        for f in fs:
            raw[f] += 1
    for t in target:
        for f in by_hand(t)[1]:
            goal[f] += 1
    s, t = sum(raw), sum(goal)
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in range(10000)]
    rows = []
    for i, n, fs in of:
        weight = sum(gain[f] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in frame.collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 40)
    monkeypatch.setattr(resample, "RANGE_ROWS", 16)


@pytest.mark.parametrize("pieces", [False, True])
def test_odd_texts(spark, docs_of, pieces, request):
    if pieces:
        request.getfixturevalue("small")
    r = random.Random(1)
    say = lambda n: " ".join(r.choice("Ab cD ef 12 é ÀB 漢字 x\x00y".split(" ")) for _ in range(n))
    texts = [None, "", "one", "A b", "é" * 300 + " " + "z" * 200 + " end", "a" * 70 + "-" + "b" * 64 + " " + "c" * 65, *[say(r.randint(1, 60)) for _ in range(120)]]
    ids = [*range(len(texts) - 4), 5, 5, None, None]  # repeated and null ids
    texts[-1] = texts[-2]
    docs, target = docs_of(texts, ids), docs_of(["ab cd ef", None, "12 12"])
    assert got(resample.resample(docs, target)) == slow(list(zip(ids, texts, strict=True)), ["ab cd ef", None, "12 12"])


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    assert resample.resample(none, none).collect() == []
    assert got(resample.resample(docs_of(["a b", None]), none, least_words=0)) == slow([(0, "a b"), (1, None)], [], least=0)


@pytest.mark.parametrize("seed", range(5))
def test_tournament_merges_as_a_sort_does(seed):
    r = random.Random(seed)
    slices, at = [], 0
    for _ in range(r.randint(1, 9)):
        keys = sorted((0, r.randint(0, 20), r.randint(0, 9)) for _ in range(r.randint(0, 12)))
        slices.append((np.arange(at, at + len(keys)), keys))
        at += len(keys)
    flat = [k for _, keys in slices for k in keys]
    count = r.randint(0, at)
    assert [flat[i] for i in resample.merge(slices, count)] == sorted(flat)[:count]


def test_checksums():
    text = "ab " + "x" * 64 + " " + "y" * 65 + " é漢 z"
    found = list(resample.features(pa.array([text]), 10**9))
    words = text.split(" ")
    assert found[0][1].tolist() == [zlib.crc32(w.encode()) % 10**9 for w in words]
    assert found[0][2].tolist() == [-1, *[zlib.crc32(f"{a} {b}".encode()) % 10**9 for a, b in zip(words, words[1:])]]


def test_query_is_the_slow_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(registry.op11_importance_resampling(spark, sf)) == slow(docs, target)


def test_names_with_dots(spark, docs_of):
    docs = docs_of(["a b c " * 9] * 8).withColumnRenamed("v", "a.b")
    found = resample.resample(docs, docs, keep=("doc_id", "a.b")).collect()
    assert len(found) == 8 and {r["a.b"] for r in found} == {"x"} and sorted(r["rank"] for r in found if r["rank"]) == [1, 2]
