import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    clean = ["the cat sat on the mat and looked at number " + str(i) * 3 + " of all the many things there " + "abc" * (i % 7) for i in range(60)]
    toxic = [f"you vile vile vile creature nr {i} go away now please " + "x" * i for i in range(40)]
    texts = clean + toxic + [clean[3], clean[4] + "!", "call +1 (234) 555-6789 or write a.b@c.dd at once, dear friend of mine", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(60 <= i < 100)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / f"out{n}"))
        step = spark.read.parquet(str(tmp_path / f"out{n}"))
        seen.append(step)
        if n < 3:
            assert step.columns == docs.columns, name
    assert {r.doc_id for r in seen[0].collect()} == set(range(60)) | set(range(100, 105))
    assert {r.doc_id for r in seen[1].collect()} == set(range(60)) | {102, 103, 104}
    masked = {r.doc_id: r for r in seen[2].collect()}
    assert masked[102].text == "call [phone] or write [email] at once, dear friend of mine" and masked[102].n_chars == len(masked[102].text)
    assert masked[5].text == clean[5] and masked[103].text is None
    assert {r.doc_id for r in seen[3].collect()} == set(masked)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[3].count()


ODD = "doc_id long, text string, `a.b` string, v string, score double, entities string, cls long"


def odd(spark, path, texts, ids=None):
    rows = [(i, t, "x", "v", 1.0, "e", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    spark.createDataFrame(rows, ODD).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return spark.read.parquet(str(path / "documents.parquet"))


def test_odd_rows_and_names(spark, tmp_path):
    same = "one two three four five six seven eight nine ten"
    docs = odd(spark, tmp_path, [same, same, same + " eleven", "other words in here that nobody else has said", None, None, ""], [1, 1, 2, 3, None, None, 4])
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in step.collect()), key=str)
    assert kept == sorted([(1, same), (3, "other words in here that nobody else has said"), (4, ""), (None, None), (None, None)], key=str)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted((i for i, _ in kept), key=str)


def test_empty_table(spark, tmp_path):
    odd(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
