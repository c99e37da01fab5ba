from tallyrift.streaming.remine import remine, running_bounds, sliding_bounds

SCHEMA = "tid long, item int, quantity int, prob double"


def test_stream_is_mined_again(spark, tmp_path):
    profits = spark.createDataFrame([(1, 2.0), (2, 3.0)], "item int, profit double")
    for n, rows in enumerate([[(1, 1, 1, 0.5), (1, 2, 1, 0.5)], [(2, 1, 4, 1.0)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = []
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = remine(stream, profits, str(tmp_path / "store"), 3, 0.1, 10, lambda b, m: found.append(m.rows))
        q.awaitTermination()
        assert found and found[-1][0][0] == ([1] if n else [2])


def test_old_batches_go(spark, tmp_path):
    profits, found = spark.createDataFrame([(1, 2.0)], "item int, profit double"), []
    for n in range(3):
        spark.createDataFrame([(10 * n + 1, 1, 1, 0.5), (10 * n + 2, 1, 1, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = remine(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), profits, str(tmp_path / "store"), 3, 0.1, 5, lambda b, m: found.append(m.rows))
        q.awaitTermination()
    assert found[-1] == [([1], 3.0, 1.0)] and len(found) == 3
    assert [p.name for p in (tmp_path / "store").glob("batch=*")] == ["batch=2"]


def test_running_sums(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1, 0.5), (2, 1, 1, 0.25)], SCHEMA).write.parquet(str(tmp_path / "in"))
    profits = spark.createDataFrame([(1, 2.0)], "item int, profit double")
    q = running_bounds(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), profits).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("sums").collect()] == [(1, 0.75, 1.5)]


def test_sliding_sums_forget(spark, tmp_path):
    profits = spark.createDataFrame([(1, 2.0), (2, -1.0)], "item int, profit double")
    rows = [(t, 1 + t % 2, t % 5 + 1, 0.5 if t % 3 else 1.0) for t in range(1, 60)]
    found = {}
    for n, (lo, hi) in enumerate([(1, 15), (15, 31), (31, 45), (45, 60)]):
        late = [(3, 1, 100, 1.0)] if n == 3 else []  # far too late: left out
        spark.createDataFrame([r for r in rows if lo <= r[0] < hi] + late, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sums = sliding_bounds(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), profits, 20, 10)
        put = lambda b, _: found.update({(r.since, r.item): (r.until, round(r.support, 6), round(r.eu, 6)) for r in b.collect()})
        sums.writeStream.foreachBatch(put).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
        last = hi - 1
        closed = {s for s, _ in found}
        assert closed == {s for s in range(-10, 60, 10) if s + 20 <= last}
    for (since, item), (until, support, eu) in found.items():
        own = [r for r in rows if since <= r[0] < until and r[1] == item]
        profit = {1: 2.0, 2: -1.0}[item]
        assert until == since + 20 and support == round(sum(r[3] for r in own), 6) and eu == round(sum(profit * r[2] * r[3] for r in own), 6)
