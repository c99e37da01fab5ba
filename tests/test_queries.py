import pytest

from helpers import same_as_sql
from tallyrift.operators import reports
from tallyrift.plans import catalog
from tallyrift.sources import runs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_is_its_sql(spark, name):
    same_as_sql(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_reports_as_text(spark):
    r = runs.derived(runs.synthetic_runs(spark, SF))
    said = reports.markdown_report(r)
    assert said.startswith("# Runs") and "Fastest: " in said and "Most pruned: " in said and "cas_efficiency: " in said and said.count("\n| ") == 5
    none = reports.markdown_report(r.where("status = 'FAILED'"))
    assert "successful 0" in none and "Fastest" not in none
    tables = reports.latex_tables(runs.successful(r))
    assert tables.count(r"\begin{tabular}") == tables.count(r"\end{tabular}") == 2 and tables.count(r" \\") == 2 + 4 + 5 + 5
    with pytest.raises(ValueError):
        reports.printed(reports.performance_table(r), reports.PERFORMANCE, " & ", most=3)


def test_reports_of_few_runs(spark):
    one = spark.createDataFrame([(1, "chess", 5, 0.1, 0.0)], "run long, dataset string, k int, min_prob double, execution_time_ms double")
    assert reports.with_speedup(one).first().speedup is None
    assert tuple(reports.curve_fit(one, "k", "execution_time_ms").first()) == (None, None, None)


def test_filters_reach_the_scan(spark):
    plan = catalog.base(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_quantity" in plan
