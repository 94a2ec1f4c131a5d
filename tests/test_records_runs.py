import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tests.fixtures import frame, raw
from wattline.config import DEFAULTS, replace
from wattline.operators import anomaly, recommend, reports
from wattline.plans import runs
from wattline.sources import csv, records, results

CFG = replace(DEFAULTS, lags=(1, 2, 3, 24, 25), windows=(7, 24), horizons={"24h": 24, "7d": 168})


@pytest.fixture(scope="module")
def energy_csv(tmp_path_factory):
    pdf = raw(300, 0).rename(columns={"ts": "utc_timestamp", "y": "load"}).drop(columns="series_id")
    pdf["utc_timestamp"] = pdf["utc_timestamp"].dt.strftime("%Y-%m-%dT%H:%M:%SZ")
    pdf = pdf.astype(object)
    pdf.loc[3, "utc_timestamp"] = "yesterday"
    pdf.loc[5, "load"] = "n/a"
    pdf["unused"] = "x"
    path = tmp_path_factory.mktemp("csv") / "energy.csv"
    pdf.to_csv(path, index=False)
    return str(path)


def test_load_csv(spark, energy_csv):
    cfg = replace(DEFAULTS, start_date="2020-01-02", end_date="2020-01-05")
    df = csv.load(spark, energy_csv, target="load", exog=["solar", "solar"], cfg=cfg)
    assert df.columns == ["series_id", "ts", "y", "solar"] and df.count() == 73
    assert df.agg(F.max("ts")).first()[0] == dt.datetime(2020, 1, 5)
    whole = csv.load(spark, energy_csv, target="load", cfg=DEFAULTS)
    assert whole.count() == 299 and whole.filter("y is null").count() == 1
    assert csv.load(spark, energy_csv, target="load", max_rows=50).count() == 50
    assert csv.load_supplementary(spark, energy_csv, ["unused"]).columns == ["unused"]


def test_only_needed_columns_are_read(spark, energy_csv):
    plan = csv.load(spark, energy_csv, target="load")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<utc_timestamp:string,load:string>" in plan


def test_upload_errors(spark):
    df = spark.createDataFrame([("2020-01-01", "x")], "day string, name string")
    with pytest.raises(ValueError, match="no time column"):
        csv.upload(df, owner="o", source="f")
    with pytest.raises(ValueError, match="not found"):
        csv.upload(df.withColumnRenamed("day", "date"), owner="o", source="f")


def test_append_scan_delete(spark, tmp_path):
    path = str(tmp_path / "records")
    base = frame(spark, pd.concat([raw(50, 0, exog=False, series=s) for s in ("a b", "c")], ignore_index=True)).withColumnRenamed("y", "value")
    records.append_records(base, path)
    records.append_records(base.filter("series_id = 'c'").limit(5), path)
    assert records.read_records(spark, path).count() == 105
    plan = records.read_records(spark, path, "c")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert records.delete_owner(spark, path, "a b") == 50
    assert records.read_records(spark, path).count() == 55
    with pytest.raises(ValueError):
        records.require_rows(records.read_records(spark, path, "a b"))
    newest = records.scan_owner(records.read_records(spark, path), "c", limit=3, newest=True).collect()
    assert [r["ts"].hour for r in newest] == [23, 0, 1]


def test_publish_keeps_versions_and_shows_the_latest(spark, tmp_path):
    path = str(tmp_path / "published")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "series_id string, v int")
    results.publish(first, path, run_id="r1")
    results.publish(first.filter("series_id = 'a'").withColumn("v", F.lit(2)), path, run_id="r2")
    assert spark.read.parquet(path).count() == 3
    assert {r["series_id"]: r["v"] for r in results.read_latest(spark, path).collect()} == {"a": 2, "b": 1}
    results.publish(first.filter("series_id = 'a'").withColumn("v", F.lit(3)), path, run_id="r2")
    assert spark.read.parquet(path).count() == 3


def test_recommendation_rules(spark):
    hours = pd.date_range("2020-06-01", periods=24, freq="h")
    fc = pd.DataFrame({"series_id": "s", "ts": hours, "y": [80000.0 if 15 <= h <= 18 else 5000.0 if h < 6 else 9000.0 for h in range(24)]})
    forecast = frame(spark, fc).withColumnRenamed("y", "forecast")
    history = frame(spark, raw(700, 0, exog=False))
    flags = frame(spark, raw(200, 0, exog=False)).withColumn("is_anomaly", (F.dayofyear("ts") % 2).cast("int"))
    imp = spark.createDataFrame(
        [("s", f, v) for f, v in [("hour_sin", 5.0), ("rolling_mean_7", 4.0), ("load_t_24", 3.0), ("is_holiday", 2.0), ("month_cos", 1.0)]],
        "series_id string, feature string, mean_abs_shap double",
    )
    recs = recommend.generate(forecast, history, flags, imp).orderBy("position").collect()
    titles = [r["title"] for r in recs]
    assert len(titles) == len(set(titles))
    rank = [{"HIGH": 0, "MEDIUM": 1, "LOW": 2}[r["priority"]] for r in recs]
    assert rank == sorted(rank)
    assert {1, 2, 6, 7, 8, 9, 10, 11} <= {r["rule_no"] for r in recs}
    by_rule = {r["rule_no"]: r for r in recs}
    assert by_rule[1]["estimated_saving_pct"] == 15.0 and by_rule[6]["priority"] == "HIGH"
    assert by_rule[1]["description"].startswith("Forecasted peak consumption (80,000 MW) is ")
    assert recommend.to_records(recommend.generate(forecast)).count() == 4


def test_rising_consumption(spark):
    pdf = raw(400, 0, exog=False)
    pdf.loc[232:, "y"] *= 1.5
    rows = recommend.week_trend(recommend.history_profile(frame(spark, pdf))).collect()
    assert len(rows) == 1 and "Week-over-Week" in rows[0]["title"]
    assert recommend.week_trend(recommend.history_profile(frame(spark, pdf.iloc[:100]))).count() == 0


def test_run_publish_dashboard_and_reload(spark, tmp_path):
    pdf = pd.concat([raw(400, i, exog=False, series=s) for i, s in enumerate("ab")], ignore_index=True)
    stored = frame(spark, pdf).withColumnRenamed("y", "value")
    args = dict(enabled=("LinearRegression", "ARIMA"), methods=("zscore", "iqr"), cfg=CFG)
    run = runs.owner_run(
        stored, publish_folder=str(tmp_path / "pub"), models_folder=str(tmp_path / "models"), out_folder=str(tmp_path / "out"), **args
    )
    assert run.tables["forecasts"].groupBy("series_id", "horizon").count().count() == 4
    board = runs.dashboard(stored, str(tmp_path / "pub"))
    stats = board["stats"].collect()
    assert [r["total_records"] for r in stats] == [400, 400] and stats[0]["horizons"] == ["24h", "7d"]
    assert board["next_day"].groupBy("series_id").count().filter("count != 24").count() == 0
    assert board["top_recommendations"].groupBy("series_id").count().filter("count > 5").count() == 0
    again = runs.full_run(stored.withColumnRenamed("value", "y"), skip_training=True, explained=True, models_folder=str(tmp_path / "models"), methods=("zscore", "iqr"), cfg=CFG)
    a, b = [r.tables["forecasts"].agg(F.sum("forecast")).first()[0] for r in (run, again)]
    assert a == pytest.approx(b, rel=1e-9)
    assert spark.read.parquet(str(tmp_path / "out" / "anomalies")).count() == 800
    assert "best_model" in spark.read.json(str(tmp_path / "out" / "metadata")).columns
    assert again.tables["importance"].filter("rank = 1").count() >= 1


def test_capping_hides_outliers_from_the_fences(spark):
    from tests.fixtures import spikes
    from wattline.operators.cleaning import clean

    df = frame(spark, spikes())
    count = lambda d: anomaly.detect(d, methods=["iqr"]).agg(F.sum("anomaly_iqr")).first()[0]
    assert count(clean(df)) == 0 and count(clean(df, winsorized=False)) >= 4


def test_concat_of_nothing(spark):
    assert reports.safe_concat([], spark).count() == 0


ROWS_ONLY = sorted(set(queries()) - set(oracle_sql()))


@pytest.mark.parametrize("name", [n for n in ROWS_ONLY if n not in ("full_run", "inference_run", "owner_run", "random_forest_search")])
def test_rows_only_queries_run(name, spark, sf001):
    assert queries()[name](spark, sf001).count() > 0
