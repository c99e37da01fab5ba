import pytest

from tallyrift.operators import encode
from tallyrift.sources import runs, tables, text


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def test_tokens(spark):
    got = text.parse_transactions(lines(spark, "", "1:2 1:2:", "1:2:0.5: 1:3:0.9", "  4:1:0.5\t5:2:0 "))
    assert sorted(map(tuple, got.collect())) == [(2, 1, 3, 0.9), (3, 4, 1, 0.5), (3, 5, 2, 0.0)]
    assert sorted(r.tid for r in text.dense_tids(got).select("tid").distinct().collect()) == [1, 2]


def test_numbers_that_are_none(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.parse_transactions(lines(spark, "a:2:0.5")).collect()
    assert text.parse_transactions(lines(spark, "a:2:0.5 1:2:0.5"), lenient=True).count() == 1


def test_profits(spark):
    got = text.parse_profits(lines(spark, "1 2.0 x", "1", "2 3.5", "2 -4.0", "", " 3\t1.0 "))
    assert sorted(map(tuple, got.collect())) == [(2, -4.0), (3, 1.0)]


def test_files_round_trip(spark, tmp_path):
    tx = spark.createDataFrame([(1, 2, 3, 0.5), (1, 1, 1, 1.0), (7, 2, 2, 0.25)], "tid long, item int, quantity int, prob double")
    text.write_transactions(tx, str(tmp_path / "db"))
    again = text.dense_tids(text.parse_transactions(text.read_lines(spark, str(tmp_path / "db"))))
    assert sorted(map(tuple, again.collect())) == [(1, 1, 1, 1.0), (1, 2, 3, 0.5), (2, 2, 2, 0.25)]


def test_validation(spark):
    bad = spark.createDataFrame([(1, 2, 3, 1.5)], "tid long, item int, quantity int, prob double")
    with pytest.raises(Exception, match="not a transaction item"):
        tables.validate(bad).collect()


def test_runs_files(spark, tmp_path):
    schema = "status string, dataset string, k int, execution_time_ms double"
    made = spark.createDataFrame([("SUCCESS", "a", 5, 1.5), ("FAILED", "a", 5, None), ("SUCCESS", "b", 10, 2.5)], schema)
    runs.save(made, str(tmp_path / "out"))
    assert runs.load(spark, str(tmp_path / "out"), schema).count() == 2
    csv = "dataset string, execution_time_ms double, k int, status string"
    assert sorted(r.k for r in runs.load(spark, str(tmp_path / "out"), csv, "csv").collect()) == [5, 10]
    assert runs.newest_path(spark, str(tmp_path / "out" / "json" / "*.json")).endswith(".json")


def test_csv_columns_go_by_name(spark, tmp_path):
    made = spark.createDataFrame([("SUCCESS", 7, 50), ("FAILED", 8, 5), ("SUCCESS", 9, None)], "status string, run int, k int")
    runs.save(made, str(tmp_path / "out"))
    for schema in ("status string, run int, k int", "run int, k int, status string", "k int, status string, run int, more double"):
        assert sorted((r.run, r.k) for r in runs.load(spark, str(tmp_path / "out"), schema, "csv").collect()) == [(7, 50), (9, None)]


def test_batches_are_added_once(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "run int, note string"
    assert runs.appended(spark, path, schema).count() == 0
    for batch in (1, 2, 2):
        runs.append(spark.createDataFrame([(batch, "x"), (batch, "y")], schema), path, batch)
    assert sorted(r.batch for r in runs.appended(spark, path, schema).collect()) == [1, 1, 2, 2]
    (tmp_path / "table" / "batch=2" / "_SUCCESS").unlink()  # as if the job had broken off
    assert {r.batch for r in runs.appended(spark, path, schema).collect()} == {1}


def test_lines_of_several_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    many = [f"{i} {i}.5" for i in range(3000)]
    (tmp_path / "in" / "b").write_text("\n".join(["1 -1.0", *many[2:]]) + "\n")
    (tmp_path / "in" / "a").write_text("1 1.0\n\n2 2.0\n")
    (tmp_path / "in" / "c").write_text("2 -2.0\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # b is read in splits
    try:
        lines = text.read_files(spark, str(tmp_path / "in"))
        got = sorted(map(tuple, lines.collect()))
        profits = {r.item: r.profit for r in text.parse_profits(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(["1 1.0", "", "2 2.0", "1 -1.0", *many[2:], "2 -2.0"]))
    assert profits[1] == -1.0 and profits[2] == -2.0 and profits[2999] == 2999.5


def test_tasks_of_transactions_stay_small(spark, tmp_path, monkeypatch):
    """What a task holds is bounded by ``TASK_ROWS``, however many lines there are; results are the same."""
    made = spark.range(6000).selectExpr("id % 1500 l_orderkey", "id % 40 l_partkey", "double(1 + id % 7) l_quantity", "id % 5 / 50 l_discount")
    made.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(40).selectExpr("id p_partkey", "'Brand#' || (11 + id % 9) p_brand").write.parquet(str(tmp_path / "part.parquet"))
    few = {item: sorted(map(tuple, tables.from_lines(spark, str(tmp_path), item).collect())) for item in ("brand", "part")}
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    for item in ("brand", "part"):
        got = tables.from_lines(spark, str(tmp_path), item)
        assert sorted(map(tuple, got.collect())) == few[item]
        sizes = got.rdd.mapPartitions(lambda rows: [len(list(rows))]).collect()
        assert len(sizes) == 12
        assert max(sizes) < 1000


def test_ranges_to_number_stay_small(spark, monkeypatch):
    monkeypatch.setattr(encode, "FEW_ROWS", 100)
    monkeypatch.setattr(encode, "TASK_ROWS", 500)
    got = encode.numbered(spark.range(6000).selectExpr("id * 7 % 6000 * 3 as x"), "place", "x")
    assert sorted(map(tuple, got.collect())) == [(3 * i, i) for i in range(6000)]
    assert got.inputFiles() and len(got.inputFiles()) >= 12


def test_lines_meet_their_parts_in_small_tasks(spark, monkeypatch):
    """Where the parts are too many to be broadcast, too, a task of the join holds about ``TASK_ROWS`` lines."""
    lines = spark.range(6000).selectExpr("id l_orderkey", "id % 40 + 40 * (id % 30) l_partkey")
    parts = spark.range(1200).selectExpr("id p_partkey", "int(id % 9) item")
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tables.of_parts(lines, parts, 6000)
        sizes = got.rdd.mapPartitions(lambda rows: [len(list(rows))]).collect()
        found = sorted(tuple(r) for r in got.select("l_orderkey", "item").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert found == [(i, (i % 40 + 40 * (i % 30)) % 9) for i in range(6000)]
    assert len(sizes) == 12 and max(sizes) < 1500


def test_many_parts_are_not_broadcast(spark, monkeypatch):
    """What each task would hold of the parts doesn't grow with their number either, whatever Spark takes their size to be."""
    lines = spark.range(6000).selectExpr("id l_orderkey", "id % 1200 l_partkey")
    parts = spark.range(1200).selectExpr("id p_partkey", "int(id % 9) item")
    for most, broadcast in ((500, False), (2000, True)):
        monkeypatch.setattr(tables, "HELD_PARTS", most)
        got = tables.of_parts(lines, parts, 6000)
        assert sorted(tuple(r) for r in got.select("l_orderkey", "item").collect()) == [(i, i % 1200 % 9) for i in range(6000)]
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == broadcast
