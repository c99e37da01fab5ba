import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tallyrift.llm import pii, registry

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_against_brute_force(docs_of):
    r = random.Random(5)
    alphabet = list("0123456789") * 3 + list("4444..@@+ab-_ ()é\u0001😀\n")
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(120))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5", "+1 (234) 555-6789.", None, "", "é😀x@y.zz"]
    texts += ["1 " * 30000, "a" * 50000 + "@b.c", "+" + "1-" * 20000, "a.b" * 9000]
    docs = docs_of(texts)
    got = {x.doc_id: [(e.kind, e.start, e.end) for e in x.entities if e.kind in pii.BASE] for x in pii.find_pii(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, t)


def test_added_kinds_scores_and_masks(docs_of, spark):
    docs = docs_of(["IBAN DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013001", "my ssn is 123-45-6789", "123-45-6789", "mail me: a@b.cc", "a@b.cc"])
    found = pii.find_pii(docs)
    got = {r.doc_id: [(e.kind, e.text) for e in r.entities] for r in found.collect()}
    assert got == {0: [("iban", "DE89 3704 0044 0532 0130 00")], 1: [], 2: [("ssn", "123-45-6789")], 3: [], 4: [("email", "a@b.cc")], 5: [("email", "a@b.cc")]}
    score = {r.doc_id: r.entities[0].score for r in found.collect() if r.entities}
    assert score[4] > score[5]
    both = found.join(docs.select("doc_id", "text"), "doc_id")
    assert {r[0]: r[1] for r in both.select("doc_id", pii.masked(both.text, both.entities)).collect()}[4] == "mail me: [email]"


def test_account_numbers_before_other_words(docs_of):
    de, gb, spaced = "DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"
    every = [f"{de} Please pay", f"{de} {gb}", f"{spaced} 42 EUR", f"{de} {spaced} {gb} A", f"AB12 {de}", f"{de}1", "é😀 " + de, f"{spaced}\n{gb}", "AB12 " * 4000 + de]
    got = {r.doc_id: [(e.start, e.text) for e in r.entities if e.kind == "iban"] for r in pii.find_pii(docs_of(every)).collect()}
    want = [[de], [de, gb], [spaced], [de, spaced, gb], [de], [], [de], [spaced, gb], [de]]
    assert got == {i: [(every[i].rindex(w), w) for w in ws] for i, ws in enumerate(want)}


def test_many_matches_in_one_text(docs_of):
    text = "".join(f"n{i}@x.yz " for i in range(16000))
    docs = docs_of([text, text])
    found = pii.find_pii(docs)
    began = time.perf_counter()
    got = found.collect()
    assert time.perf_counter() - began < 30  # half a minute where steps grow with the square takes minutes
    assert all(len(r.entities) == 16000 and text[r.entities[-1].start : r.entities[-1].end] == "n15999@x.yz" for r in got)
    both = found.join(docs.select("doc_id", "text"), "doc_id").select(pii.masked(F.col("text"), F.col("entities")))
    assert [r[0] for r in both.collect()] == ["[email] " * 16000] * 2


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cc é 1.2.3.4"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.op4_pii(spark, str(tmp_path)).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:9:16").hexdigest() and got[1].n_ip == 1
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0
