import random

import numpy as np
import pytest

from tallyrift.llm import piecefst


def test_ids_are_the_librarys(docs_of, tokenizer):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(9)
    alphabet = list("abcdefgthein   \n\t▁éñ中😀.,!0123²'(") + ["the ", "  ", "ing"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(1500)] + [" " * 500, "a" * 5000, "\u0000x", "word " * 4000]
    fst = piecefst.transducer(path)
    for t in texts:
        ids = np.frombuffer(fst.encode(t), "<u4").tolist()
        assert ids == sp.encode(t), t
        assert fst.decode(ids) == t.replace("▁", " ")
    docs = docs_of([*texts[:50], None, ""])
    got = piecefst.encode(docs, path)
    assert all(x.round_trip and len(x.ids) == x.n_ids for x in got.collect())
    back = {x.doc_id: x.text for x in piecefst.decode(got, path).collect()}
    assert back == {**{i: t.replace("▁", " ") for i, t in enumerate(texts[:50])}, 50: "", 51: ""}
    assert piecefst.encode(docs.limit(0), path).count() == 0


def test_shortest_path_is_merging(tokenizer):
    fst = piecefst.transducer(tokenizer("piece_bpe_32k.model"))
    r = random.Random(2)
    for _ in range(500):
        t = "▁" + "".join(r.choice("abcdefghiklmnoprstuéx") for _ in range(r.randrange(1, 14)))
        assert fst.path(t) == fst.merge(t)


NAMES = "▁ a b c ab bc abc ▁a ▁ab ▁b é 中 a1 1 ▁▁ x. . ABC -- ▁é caf ▁caf é! ! t h e th he the ▁the in ing ▁in".split(" ")


def made_model(tmp_path, name, kind, user=(), fallback=True, trim=True, rewrites=None):
    """A model put together by hand, not trained: pieces with scores, and a normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, r = pb.ModelProto(), random.Random(4)
    add = lambda piece, score, what: model.pieces.add(piece=piece, score=score, type=what)
    add("<unk>", 0, 2)
    add("<s>", 0, 3)
    add("</s>", 0, 3)
    for u in user:
        add(u, 0, 4)
    if fallback:
        for i in range(256):
            add(f"<0x{i:02X}>", 0, 6)
    for i, n in enumerate(NAMES):
        add(n, -float(i) if kind == 2 else -round(2 + 6 * r.random(), 2), 1)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = kind, fallback
    model.trainer_spec.user_defined_symbols.extend(user)
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = True, trim, True
    if rewrites:
        model.normalizer_spec.precompiled_charsmap = rewrites
    path = tmp_path / name
    path.write_bytes(model.SerializeToString())
    return str(path)


def compiled(rules):
    """A character map as the library compiles it from rules."""
    import sentencepiece

    norm = sentencepiece.SentencePieceNormalizer(rule_name=rules)
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(norm.serialized_model_proto())
    return model.normalizer_spec.precompiled_charsmap


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize(("user", "fallback", "trim", "rules"), [((), True, True, None), (("<sep>", "ab1"), True, False, None), ((), False, True, None), ((), True, True, "nmt_nfkc"), (("<sep>",), False, True, "nfkc_cf")])
def test_made_models_are_the_librarys(tmp_path, kind, user, fallback, trim, rules):
    import sentencepiece

    path = made_model(tmp_path, "m.model", kind, user, fallback, trim, compiled(rules) if rules else None)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    fst = piecefst.Transducer(path)
    r = random.Random(6)
    alphabet = list("abcabcthe  in.1é中!A-xZ") + ["the ", "  ", "ing", "<sep>", "ab1", "ﬁ", "Ａ", "①", "e\u0301", "zz"]
    for _ in range(600):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        assert np.frombuffer(fst.encode(t), "<u4").tolist() == sp.encode(t), t


def test_odd_ids_and_repeated_rows(docs_of, tokenizer, spark):
    path = tokenizer("piece_bpe_32k.model")
    got = piecefst.encode(docs_of(["a b", "a b"], [1, 1]), path).collect()
    assert got[0] == got[1]
    odd = spark.createDataFrame([(1, [None, -1, 10**9, got[0].ids[0]]), (2, None)], "doc_id long, ids array<long>")
    assert {r.doc_id: r.text for r in piecefst.decode(odd, path).collect()} == {1: "a", 2: ""}


def test_query_returns_ids_and_text(spark):
    from tallyrift.llm import registry

    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in registry.op8_sentencepiece(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert found.keys() == texts.keys()
    for i, r in found.items():
        assert len(r.ids) == r.n_ids and r.round_trip == (r.decoded == (texts[i] or "").replace("\u2581", " "))
    assert sum(r.round_trip for r in found.values()) > 0.9 * len(found)
