import pytest

from tallyrift.llm import registry
from tallyrift.llm.sharding import shard_rows, write_shards


@pytest.mark.parametrize("limit", [100, 2000, 10**6])
def test_shards_fit_and_are_minimal(docs_of, limit):
    texts = ["x" * (i * 7 % 90) for i in range(500)] + [None, "y" * 5000]
    docs = docs_of(texts)
    rows = shard_rows(docs, limit).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    size = {}
    for r in rows:
        size[r.shard_id] = size.get(r.shard_id, 0) + r.bytes
    assert all(size[r.shard_id] == r.shard_bytes for r in rows)
    assert all((r.shard_bytes > limit) == r.oversized for r in rows)
    big = {r.shard_id for r in rows if r.oversized}
    assert all(sum(1 for r in rows if r.shard_id == s and r.bytes) == 1 for s in big)
    ids = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(ids, ids[1:]))  # a prefix code
    for s in ids:  # what was split had to be
        if s:
            assert sum(n for t, n in size.items() if t.startswith(s[:-1])) > limit


def slow_shards(rows, limit, bits=60):
    """The directory by hand: a bucket over the limit is split on its next bit unless all its rows have one hash."""
    todo, out = [("", rows)], {}
    while todo:
        prefix, own = todo.pop()
        if sum(n for _, _, n in own) <= limit or len({h for _, h, _ in own}) == 1 or len(prefix) == bits:
            out |= {i: prefix for i, _, _ in own}
        else:
            for bit in "01":
                if part := [r for r in own if f"{r[1]:060b}"[len(prefix)] == bit]:
                    todo.append((prefix + bit, part))
    return out


@pytest.mark.parametrize("limit", [60, 700, 5000])
def test_against_the_slow_directory(docs_of, spark, limit):
    docs = docs_of(["é" * (i * 13 % 41) for i in range(400)] + ["z" * 9000, None], list(range(398)) + [5, 5, 7, 9])
    hashed = docs.selectExpr("doc_id", "shiftrightunsigned(xxhash64(doc_id), 4) as h", "coalesce(octet_length(text), 0) as n").collect()
    want = slow_shards([(r.doc_id, r.h, r.n) for r in hashed], limit)
    rows = shard_rows(docs, limit).collect()
    assert len(rows) == 402 and {r.doc_id: r.shard_id for r in rows} == want


def test_query_splits(spark):
    """The query's own limit, as a share of a small table's bytes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shard_rows(docs, registry.SHARD_BYTES >> 6).collect()
    assert len({r.shard_id for r in rows}) > 4 and not any(r.oversized for r in rows)


def test_copies_and_nothing(docs_of):
    rows = shard_rows(docs_of(["abc"] * 50, [7] * 50), 10).collect()
    assert len(rows) == 50 and len({r.shard_id for r in rows}) == 1 and rows[0].oversized
    assert shard_rows(docs_of(["a"]).limit(0), 10).count() == 0


def test_written(docs_of, tmp_path, spark):
    docs = docs_of(["x" * 50 for _ in range(40)])
    write_shards(docs, shard_rows(docs, 400), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_written_rows_are_the_rows_given(docs_of, tmp_path, spark):
    docs = docs_of([f"{i}" * 40 for i in range(30)], [*range(24), 5, 5, 5, None, None, 23])
    write_shards(docs, shard_rows(docs, 300), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(map(str, (r.text for r in docs.collect())))
    assert back.where("doc_id is null").count() == 2 and back.where("doc_id = 5").select("shard_id").distinct().count() == 1
