"""Blocks of moments against one pass over the days."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from pricewatch import schemas
from pricewatch.operators import moment_blocks
from pricewatch.plans import forecasting
from pricewatch.config import EvalWindow, Settings

SETTINGS = Settings(
    eval_windows=(
        EvalWindow("short", date(2020, 11, 30), date(2020, 12, 1), date(2020, 12, 31)),
        EvalWindow("mid", date(2020, 6, 30), date(2020, 7, 1), date(2020, 12, 31)),
        EvalWindow("long", date(2019, 12, 31), date(2020, 1, 1), date(2020, 12, 31)),
    )
)
CUTS = [w.train_end for w in SETTINGS.eval_windows]


def panel(spark, seed=1):
    rng = random.Random(seed)
    start = date(2019, 1, 5).toordinal()
    rows = []
    for series, share in (("dense", 0.95), ("sparse", 0.08), ("rare", 0.01), ("flat", 0.5), ("edge", 0.3)):
        for i in range(0, 760):
            if rng.random() < share or i in (3, 759):
                price = 500.0 if series == "flat" else 1000 + 50 * rng.random() + i / 3
                gone = rng.random() < 0.1 or (series == "edge" and (i < 40 or i > 700))
                rows.append((series, date.fromordinal(start + i), rng.choice([None, 0.0]) if gone else price))
    rows += [("one", date(2019, 3, 3), 7.0), ("two", date(2019, 3, 31), 7.0), ("two", date(2019, 4, 1), 8.0)]
    rows += [("never", date(2019, 3, 3), None)]
    seen = {}
    for r in rows:
        seen[r[:2]] = r
    return spark.createDataFrame(sorted(seen.values(), key=repr), schemas.PRICE_OBS).repartition(5)


def plain(obs):
    fits = forecasting._fits(
        forecasting._cut_segments(obs, SETTINGS.eval_windows, SETTINGS), forecasting.filling(SETTINGS)
    )
    return {(r["series_id"], r["train_end"]): r.asDict() for r in fits.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, w in want.items():
        for name, value in w.items():
            g = got[key][name]
            if isinstance(value, float):
                assert g == pytest.approx(value, rel=1e-7, abs=1e-7), (key, name)
            elif isinstance(value, list):
                assert [x is None for x in g] == [x is None for x in value], (key, name)
                assert [x or 0.0 for x in g] == pytest.approx([x or 0.0 for x in value], rel=1e-7, abs=1e-6), (key, name)
            else:
                assert g == value, (key, name)


def collected(blocks):
    return {(r["series_id"], r["train_end"]): r.asDict() for r in moment_blocks.fits(blocks, CUTS).collect()}


def test_blocks_add_up_to_one_pass(spark):
    obs = panel(spark)
    same(collected(moment_blocks.build(obs)), plain(obs))


def test_loads_in_any_order_and_corrections(spark, tmp_path):
    obs = panel(spark, 2)
    path = str(tmp_path / "blocks")
    wrong = obs.withColumn("price", F.when(F.month("date") == 5, F.col("price") * 3).otherwise(F.col("price")))
    for chosen in (F.year("date") == 2020, F.month("date") <= 5, F.col("date") > date(2019, 8, 31)):
        moment_blocks.store(moment_blocks.build(wrong.filter(chosen)), path)
    moment_blocks.store(moment_blocks.build(wrong.filter(F.year("date").isin(2019, 2021))), path)
    months = F.month("date") == 5
    before = {r["f"] for r in spark.read.parquet(path).filter("year = 2021").select(F.input_file_name().alias("f")).collect()}
    moment_blocks.store(moment_blocks.build(obs.filter(months)), path)
    after = {r["f"] for r in spark.read.parquet(path).filter("year = 2021").select(F.input_file_name().alias("f")).collect()}
    assert before == after  # untouched years keep their files
    same(collected(moment_blocks.read(spark, path)), plain(obs))


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], schemas.PRICE_OBS)
    assert moment_blocks.fits(moment_blocks.build(empty), CUTS).count() == 0
    assert moment_blocks.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        moment_blocks.fits(moment_blocks.build(empty), [date(2020, 6, 15)])


def test_a_fit_reads_no_days(spark, tmp_path):
    path = str(tmp_path / "blocks")
    moment_blocks.store(moment_blocks.build(panel(spark)), path)
    plan = moment_blocks.fits(moment_blocks.read(spark, path), CUTS)._jdf.queryExecution().executedPlan().toString()
    assert "price_obs" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
