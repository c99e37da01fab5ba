import pytest

from tallyrift.__main__ import main
from tallyrift.plans.mine import Mined
from tallyrift.sources import results


def test_run(spark, tmp_path, capsys):
    (tmp_path / "db").write_text("1:2:0.5 2:1:1.0\n\n2:3:0.9\nbroken\n")
    (tmp_path / "pr").write_text("1 3.0\n2 -1.0\n")
    out = main([str(tmp_path / "db"), str(tmp_path / "pr"), "5", "0.1", "--out", str(tmp_path / "out")])
    assert out[0].startswith("transactions 2, items 2, k 5") and out[-1] == "2. {1, 2}: utility 2.50, probability 0.5000"
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in kept.orderBy("rank").select("rank", "items").collect()] == [(1, [1]), (2, [1, 2])]
    results.save(kept, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_four_arguments():
    with pytest.raises(SystemExit):
        main(["a", "b"])


def test_printed_lines():
    mined = Mined([([1, 2], 3.14159, 0.98765)], 0.5)
    assert list(results.ranked(mined)) == ["1. {1, 2}: utility 3.14, probability 0.9877"]
    assert results.configuration(5, 3, 2, 0.1, 8) == "transactions 5, items 3, k 2, least probability 0.1, cores 8"
    said = results.progress({"level": 2, "candidates": 7, "survivors": 3, "threshold": 1.23456})
    assert said == "level 2: 7 candidates, 3 go on, threshold 1.2346"
