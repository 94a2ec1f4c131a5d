import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.fixtures import frame, raw, sorted_pdf
from wattline.config import DEFAULTS, replace
from wattline.functions.calendar import is_holiday
from wattline.operators import cleaning, features, quality


@pytest.fixture(scope="module")
def dirty(spark):
    pdf = raw(400, 1, exog=False)
    pdf.loc[10:13, "y"] = None
    pdf.loc[80, "y"] = 999999.0
    pdf.loc[150, "y"] = -80000.0
    pdf = pd.concat([pdf, pdf.iloc[[0]].assign(y=1.0)], ignore_index=True)
    pdf["seq"] = range(len(pdf))
    return frame(spark, pdf).cache()


def test_dedup_keeps_first(dirty):
    out = sorted_pdf(cleaning.dedup_first(dirty, ingest_order="seq"))
    assert len(out) == 400 and out["seq"].iloc[0] == 0


def test_clean_bounds(dirty):
    out = sorted_pdf(cleaning.clean(dirty, ingest_order="seq"))
    assert len(out) == 400 and out["y"].notna().all()
    assert out["y"].max() < 999999 and out["y"].min() > -80000


def test_unknown_strategy_falls_back(dirty):
    a = sorted_pdf(cleaning.fill_missing(dirty.drop("seq"), "strange"))
    b = sorted_pdf(cleaning.fill_missing(dirty.drop("seq"), "interpolate"))
    pd.testing.assert_frame_equal(a, b)
    assert cleaning.fill_missing(dirty, "drop").count() == 397
    assert cleaning.winsorise(dirty, "strange").count() == dirty.count()


def test_gap_of_twenty(spark):
    pdf = raw(300, 0)
    pdf.loc[50:69, "y"] = None
    out = cleaning.fill_missing(frame(spark, pdf))
    assert out.filter("y is null").count() == 0


@pytest.mark.parametrize("n,ok", [(10, False), (99, False), (100, True)])
def test_minimum_rows(spark, n, ok):
    df = frame(spark, raw(n, exog=False))
    if ok:
        quality.validate(df)
    else:
        with pytest.raises(quality.ValidationError, match="too few rows"):
            quality.validate(df)


def test_validation_collects_all_problems(spark):
    pdf = raw(50, exog=False)
    pdf["y"] = None
    df = frame(spark, pdf).withColumn("ts", F.col("ts").cast("string"))
    with pytest.raises(quality.ValidationError) as err:
        quality.validate(df, required=("ts", "y", "solar"))
    for part in ("timestamp", "solar", "too few rows", "entirely null"):
        assert part in str(err.value)


def test_report_counts_duplicates(dirty):
    rows = {r["column_name"]: r for r in quality.report(dirty).collect()}
    assert rows["y"]["missing"] == 4 and rows["y"]["duplicated_rows"] == 1 and rows["y"]["total_rows"] == 401


def test_feature_rows_and_names(spark):
    import numpy as np

    pdf = raw(200, exog=False)
    pdf["y"] = 10 * np.sin(np.arange(200)) + 50
    out = features.transform(frame(spark, pdf))
    assert out.count() == 31
    assert features.feature_columns(out) == features.feature_names()
    assert len(features.feature_names()) == 37 and len(features.feature_names(["a", "b", "c", "d"])) == 109


def test_lag_correlation(spark):
    out = features.transform(frame(spark, raw(700, exog=False))).toPandas()
    assert out["y"].corr(out["load_t_1"]) > 0.9


def test_missing_columns_become_zero(spark):
    out = features.fill_missing_features(frame(spark, raw(5)), ["solar", "other"], keep=["ts"])
    assert out.columns == ["ts", "solar", "other"] and out.filter("other != 0").count() == 0


def test_holidays(spark):
    days = ["2020-01-01", "2020-04-10", "2020-04-13", "2020-05-21", "2020-06-01", "2020-10-03", "2017-10-31", "2018-10-31", "2020-12-24", "2020-12-26"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(is_holiday(F.col("d").cast("date")).alias("h"))
    assert [r["h"] for r in df.collect()] == [1, 1, 1, 1, 1, 1, 1, 0, 0, 1]
    with pytest.raises(ValueError):
        is_holiday(F.lit("2020-01-01"), "XX")


def test_config_is_replaceable():
    assert replace(DEFAULTS, seed=7).seed == 7 and DEFAULTS.seed == 42


def test_copies_without_an_order_prefer_values(spark):
    rows = [("s", 5.0, 1.0), ("s", None, 1.0), ("t", None, 2.0), ("t", None, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, y double, x double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = {r["series_id"]: (r["y"], r["x"]) for r in cleaning.dedup_first(df.select("series_id", "ts", "y", "x")).collect()}
    assert got == {"s": (5.0, 1.0), "t": (None, 1.0)}


def test_text_upload_without_the_target(spark):
    from wattline.sources import csv

    df = spark.createDataFrame([("2024-01-01", "a", "1.5"), ("2024-01-02", "b", "")], "timestamp string, kind string, load string")
    records, summary = csv.upload(df, owner="o", source="f")
    assert [r["value"] for r in records.collect()] == [1.5] and "'load'" in summary.first()["warnings"][0]
