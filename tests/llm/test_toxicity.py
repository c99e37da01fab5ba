import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyrift.llm import toxicity
from tallyrift.llm.toxicity import Matcher, monotonic, terms_of, toxicity_scores


def made(n=600, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts, toxic = [], []
    for _ in range(n):
        bad = r.random() < 0.3
        w = r.choices(words, k=40) + (["vile" + r.choice(["", "st", "ness"]) for _ in range(3)] + ["scoundrel"] if bad else [])
        r.shuffle(w)
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy(docs_of, spark):
    texts, toxic = made()
    docs = docs_of([*texts, None, "", "... 12 !", "vile scoundrel vile " * 20000])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (99999, 1), (3, None)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    got = {r.doc_id: r for r in toxicity_scores(docs, labels, fold != 1).collect()}
    assert len(got) == len(texts) + 4 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i].score >= 0.7) == bool(toxic[i]) for i in held)
    assert right >= 0.97 * len(held)
    assert got[len(texts)].score < 0.3 and got[len(texts) + 3].score > 0.7
    assert all(e % 1 == 0 and zlib.crc32(str(e).encode()) % 3 != 1 for r in got.values() for e in r.evidence)


def test_without_labels_or_rows(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity_scores(docs_of(["a b"]), none, F.lit(True)).collect()] == [0.1]
    assert toxicity_scores(docs_of(["a"]).limit(0), none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert len(toxicity_scores(docs_of(["a b", "c"]), one, F.lit(True), keep=("doc_id", "text", "score"), names=("s", "e")).columns) == 5


def vectors_of(r, n, terms):
    out = []
    for _ in range(n):
        ids = np.sort(r.choice(terms, r.integers(1, 9), replace=False))
        out.append((ids, r.integers(1, 4, len(ids)).astype(float)))
    return out


def test_search_is_exact(monkeypatch):
    r = np.random.default_rng(1)
    n, terms = 700, 40
    vectors = vectors_of(r, n, terms)
    vectors[5:9] = [vectors[4]] * 4  # ties
    toxic = r.integers(0, 2, n)
    monkeypatch.setattr(toxicity, "COMMON", 0.13)  # some terms have rows, some postings
    begin = np.append(0, np.cumsum([len(v[0]) for v in vectors]))
    names, flat = [f"t{i:02d}" for i in range(terms)], [np.concatenate([v[i] for v in vectors]) for i in (0, 1)]
    index = toxicity.build(list(range(n)), toxic, names, begin, flat[0].astype(np.int32), flat[1].astype(np.int32), r.integers(1, 50, terms), 1000, (n, n), 15)
    dense, place = np.zeros((n, terms)), {t: i for i, t in enumerate(index.vocabulary.split("\n"))}
    assert 0 < index.wide < terms
    assert np.allclose(np.sort(pickle.loads(pickle.dumps(index)).value), np.sort(index.value))
    for row, at in enumerate(index.ids):
        own = np.array([place[f"t{i:02d}"] for i in vectors[at][0]])
        dense[row, np.sort(own)] = index.unit(np.sort(own), vectors[at][1][np.argsort(own)])
    for _ in range(80):
        ids, tf = vectors_of(r, 1, terms)[0]
        w = index.unit(ids, tf)
        near, cos = next(index.all_nearest(np.array([0, len(ids)]), ids, tf, 15))
        full = dense[:, ids] @ w
        last = np.sort(full)[::-1][14]
        want = np.flatnonzero(full >= max(last - 1e-12, 1e-8))
        assert sorted(near.tolist()) == want.tolist() and np.allclose(cos, full[near])
    assert index.most.tolist() == [index.value[a:b].max() for a, b in zip(index.postings[:-1], index.postings[1:], strict=True)]


def slow_scores(texts, labelled, k=15):
    """All of it again with dictionaries: labelled is {text number: toxic}."""
    parsed = [Counter() for _ in texts]
    for c, t in zip(parsed, texts, strict=True):
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            c.update([w, *(w[:s] + "*" for s in (4,) if len(w) >= s)])
    toxic, clean = [i for i, y in labelled.items() if y], [i for i, y in labelled.items() if not y]
    terms = {t for i in labelled for t in parsed[i]}
    weight = {}
    for t in terms:
        df = sum(t in c for c in parsed)
        odds = [math.log((sum(t in parsed[i] for i in group) + 0.5) / (len(group) + 1)) for group in (toxic, clean)]
        weight[t] = (math.log((len(texts) + 1) / (df + 1)) + 1e-3) * abs(odds[0] - odds[1])

    def unit(c):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in terms}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()} if size else v

    units = [unit(c) for c in parsed]

    def vote(i, own):
        cos = {j: sum(x * units[j].get(t, 0.0) for t, x in units[i].items()) for j in labelled if j != own}
        best = sorted(cos.values(), reverse=True)
        near = [j for j, c in cos.items() if c >= max(best[min(k, len(best)) - 1] * (1 - 1e-12), 1e-8)]
        if not near:
            return None
        w = {j: 1 / (1.05 - cos[j]) for j in near}
        return (sum(w[j] * labelled[j] for j in near) + len(toxic) / len(labelled) / 1.05) / (sum(w.values()) + 1 / 1.05)

    alone = {i: vote(i, i) for i in labelled}
    none = [0.5 + sum(v is None for v in alone.values()), 0.05 + sum(labelled[i] for i, v in alone.items() if v is None)]
    some = [i for i, v in alone.items() if v is not None]
    x, y = monotonic(np.array([alone[i] for i in some]), np.array([labelled[i] for i in some], float), np.ones(len(some)))
    out = []
    for i in range(len(texts)):
        v = vote(i, None)
        out.append(none[1] / none[0] if v is None else 0.97 * float(np.interp(v, x, y)) + 0.03 * v)
    return out


def test_whole_score_equals_the_slow_one(docs_of, spark):
    texts, toxic = made(150, seed=9)
    texts = [*texts, None, "", "12 !", texts[0], texts[0], texts[7], "ab"]
    labelled = {i: toxic[i] for i in range(150) if zlib.crc32(str(i).encode()) % 3 != 1}
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity_scores(docs_of(texts), labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1).collect()}
    want = slow_scores(texts, labelled)
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-9)
    assert got[153] == got[154] == got[0]  # repeated rows


def test_ids_of_other_kinds_and_with_several_texts(spark):
    docs = spark.createDataFrame([("a", "vile scum"), ("a", "good day"), ("b", "good day all"), ("c", "vile")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "doc_id string, toxic int")
    got = toxicity_scores(docs, labels, F.lit(True)).collect()
    assert len(got) == 4 and {e for r in got for e in r.evidence} <= {"a", "b"}


def test_terms_and_fit():
    assert terms_of("Abcdef abcdef") == {"abcdef": 2, "abcd*": 2}
    begin, ids, tf = Matcher("abcd*\nabcdef\nzz")(["abcdef Abcdef abcd " + "x" * 100, None, "zz abcdef"])
    assert begin.tolist() == [0, 2, 2, 5] and ids.tolist() == [0, 1, 0, 1, 2] and tf.tolist() == [3, 2, 1, 1, 1]
    x, y = monotonic(np.array([0.0, 0.5, 1.0]), np.array([0.0, 1.0, 1.0]), np.ones(3))
    assert (np.diff(y) >= 0).all() and y[0] < 0.5 < y[-1]


def test_words_of_the_same_terms_have_one_number():
    vocabulary = ["appl*", "apple", "pear"]
    words = [f"{start}{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(300) for start in ("appl", "zz", "pearl")]
    texts = [" ".join(words), "apple pear apple apples pear", None, "", " ".join(words[:50]) + " apple"]
    match = toxicity.Matcher("\n".join(vocabulary))
    for _ in range(2):
        begin, term, tf = match(texts)
        got = [{vocabulary[t]: int(n) for t, n in zip(term[a:b], tf[a:b], strict=True)} for a, b in zip(begin[:-1], begin[1:], strict=True)]
        assert got == [{t: n for t, n in toxicity.terms_of(x).items() if t in vocabulary} for x in texts]
    assert len(match.of) == 4


def test_words_of_ascii_texts_and_others():
    every = "".join(map(chr, range(128)))
    for x in (every, every * 2 + "\u0130\xdf\u017f x\u0301y", "Ab-cD_e1f\x00g", ""):
        assert toxicity.words_of(x.lower()) == toxicity.WORD.findall(x.lower())


def test_texts_are_matched_once(docs_of, spark, tmp_path):
    """Unless texts are kept, they are read for what is found in them and not again; the scores are the same."""
    texts, toxic = made(80)
    docs_of([*texts, None, texts[3]]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    found = {keep: toxicity_scores(docs, labels, F.lit(True), keep=keep) for keep in (("doc_id", "text"), ("doc_id",))}
    assert all("matched-" in f for f in found["doc_id",].inputFiles())
    got = [sorted((r.doc_id, r.score, *r.evidence) for r in x.collect()) for x in found.values()]
    assert got[0] == got[1] and len(got[0]) == 82
