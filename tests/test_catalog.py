"""Every registered query against its check SQL, and the shape of the main plans."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from pricewatch.catalog import registry
from pricewatch.catalog.fixture import SETTINGS
from pricewatch.plans import evaluation, forecasting, report, risk
from pricewatch.sources import panels

SF = "/root/testdata/sf0.001"
TABLES = "customer events lineitem nation orders part region supplier".split()
CHECKED = sorted(registry.oracles())
ROWS_ONLY = sorted(set(registry.queries()) - set(CHECKED))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", CHECKED)
def test_query_matches_its_check(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(df.collect(), df.columns) == normal(cursor.fetchall(), names)


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_query_without_check_runs(spark, key):
    assert entry.queries()[key](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 15


def test_dashboard_frames(spark):
    frames = report.dashboard(panels.price_obs(spark, SF), SETTINGS)
    assert set(frames) == {"prices", "timeline", "volatility", "summary", "forecast", "risk", "cards"}
    assert frames["cards"].count() == 15


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forecasts_exchange_the_panel_once(spark, tmp_path):
    path = str(tmp_path / "obs")
    panels.price_obs(spark, SF).write.parquet(path)
    obs = spark.read.parquet(path)
    text = plan(forecasting.forecast_backtest(obs, SETTINGS))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "Join" not in text and "ReadSchema: struct<series_id:string,date:date,price:double>" in text


def final_plan(df):
    df.collect()
    return plan(df).split("Initial Plan")[0]


@pytest.mark.parametrize(
    "job",
    [
        lambda o: evaluation.backtest_metrics(o, SETTINGS),
        lambda o: report.backtest_summary(forecasting.place(o), SETTINGS),
        lambda o: evaluation.compare_models(o, SETTINGS),
        lambda o: evaluation.compare_log_variants(o, SETTINGS),
    ],
    ids=["backtest_metrics", "backtest_summary", "compare_models", "compare_log_variants"],
)
def test_evaluations_read_the_panel_once(spark, tmp_path, job):
    path = str(tmp_path / "obs")
    panels.price_obs(spark, SF).write.parquet(path)
    text = final_plan(job(spark.read.parquet(path)))
    assert len(re.findall(r"\bFileScan parquet\b|Scan parquet", text)) == 1
    assert len(re.findall(r"\+- Exchange hashpartitioning", text)) == 1


def test_payload_reads_the_panel_once(spark, tmp_path):
    path = str(tmp_path / "obs")
    panels.price_obs(spark, SF).write.parquet(path)
    text = final_plan(report.payload(spark.read.parquet(path), SETTINGS))
    assert len(re.findall(r"Scan parquet", text)) == 1


def test_timeline_reads_the_panel_once(spark, tmp_path):
    path = str(tmp_path / "obs")
    panels.price_obs(spark, SF).write.parquet(path)
    obs = forecasting.place(spark.read.parquet(path))
    lines = report.timeline(
        report.placed_chart_prices(obs, SETTINGS.chart_range),
        forecasting.forecast_backtest(obs, SETTINGS),
        forecasting.forecast_operational(obs, SETTINGS),
    )
    text = final_plan(lines)
    assert len(re.findall(r"Scan parquet", text)) == 1


def test_risk_reads_one_exchange(spark, tmp_path):
    path = str(tmp_path / "obs")
    panels.price_obs(spark, SF).write.parquet(path)
    df = risk.assess(spark.read.parquet(path), SETTINGS)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert len(re.findall(r"\+- Exchange hashpartitioning", final)) == 1
    assert "ReusedExchange" in final and "CartesianProduct" not in final


@pytest.mark.parametrize(
    "job",
    [
        lambda o: forecasting.backtest_fits(forecasting.place(o), SETTINGS),
        lambda o: risk.assess(o, SETTINGS),
        lambda o: forecasting.operational_fits(o, SETTINGS, trim=False),
    ],
    ids=["fits", "risk", "unplaced"],
)
def test_small_partitions_of_a_placed_panel_are_not_merged(spark, job):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert job(panels.price_obs_supplier(spark, SF)).rdd.getNumPartitions() == 24
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
