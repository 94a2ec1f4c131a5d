"""The chunked plan equals the plain one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.fixtures import frame, raw, sorted_pdf
from wattline.operators import cleaning, features, metrics, ordering, reports


@pytest.fixture(scope="module")
def two(spark):
    a, b = raw(700, 1, series="a"), raw(90, 2, series="b")
    a.loc[5:20, "y"] = None
    a.loc[300:303, "y"] = None
    a.loc[690:, "y"] = None
    b.loc[:3, "y"] = None
    b.loc[40:80, "solar"] = None
    return frame(spark, pd.concat([a, b], ignore_index=True)).cache()


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Keep the range partitions apart, so that offsets between them matter."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def same(x, y):
    pd.testing.assert_frame_equal(sorted_pdf(x)[sorted(x.columns)], sorted_pdf(y)[sorted(x.columns)], rtol=1e-12, atol=1e-12)


def test_positions(two):
    plain = ordering.positions(two, ["series_id"], ["ts"], total="n", plan="plain")
    same(plain, ordering.positions(two, ["series_id"], ["ts"], total="n", plan="chunked"))


@pytest.mark.parametrize("chunk", [170, 250])
def test_features(two, chunk):
    kw = dict(exog=["solar"], drop_incomplete=False)
    same(features.transform(two, plan="plain", **kw), features.transform(two, plan="chunked", chunk_rows=chunk, **kw))


def test_chunk_must_exceed_halo(two):
    with pytest.raises(ValueError):
        features.add_lags(two, plan="chunked", chunk_rows=100)


@pytest.mark.parametrize("strategy", ["interpolate", "ffill", "bfill"])
def test_fill(two, strategy):
    plain = cleaning.fill_missing(two, strategy, plan="plain")
    assert plain.filter("y is null or solar is null").count() == 0
    same(plain, cleaning.fill_missing(two, strategy, plan="chunked", chunk_rows=10))


def test_fill_matches_pandas(two):
    got = sorted_pdf(cleaning.fill_missing(two, "interpolate"))
    want = []
    for _, pdf in sorted_pdf(two).groupby("series_id"):
        filled = pdf.set_index("ts")[["y", "solar", "wind"]].interpolate(method="time", limit=6).ffill().bfill()
        want.append(filled)
    np.testing.assert_allclose(got[["y", "solar", "wind"]].to_numpy(), pd.concat(want).to_numpy(), rtol=1e-12)


def test_rolling_matches_pandas(two):
    got = sorted_pdf(features.add_rolling(two.na.fill(0.0)))
    for _, g in got.groupby("series_id"):
        past = g["y"].shift(1).rolling(30, min_periods=1)
        np.testing.assert_allclose(g["rolling_mean_30"], past.mean(), rtol=1e-9)
        np.testing.assert_allclose(g["rolling_std_30"], past.std(), rtol=1e-6, atol=1e-4)


def test_quantiles(two):
    probs = {"a": 0.0, "b": 0.25, "c": 0.37, "d": 0.9, "e": 1.0}
    plain = ordering.quantiles(two, "y", probs, plan="plain")
    same_q = ordering.quantiles(two, "y", probs, plan="chunked")
    x, y = [d.toPandas().sort_values("series_id").reset_index(drop=True) for d in (plain, same_q)]
    pd.testing.assert_frame_equal(x, y, rtol=1e-12)
    pdf = two.toPandas()
    for row in x.itertuples():
        v = pdf.loc[pdf.series_id == row.series_id, "y"].dropna()
        np.testing.assert_allclose([row.a, row.b, row.c, row.d, row.e], np.quantile(v, list(probs.values())))


def test_split_and_downsample(two):
    for op in (lambda p: metrics.time_split(two, val_size=0.1, plan=p), lambda p: reports.downsample(two, 50, plan=p)):
        same(op("plain"), op("chunked"))


def test_tail_reaches_the_map_side(two, spark):
    plan = ordering.tail(two, 24)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert ordering.tail(two, 24).groupBy("series_id").count().filter("count != 24").count() == 0


def test_auto_switches_by_size(two, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_GROUP_ROWS", 100)
    assert ordering.choose_plan(two, ["series_id"]) == "chunked"
    assert ordering.choose_plan(two.filter(F.col("series_id") == "b"), ["series_id"]) == "plain"
    with pytest.raises(ValueError):
        ordering.choose_plan(two, ["series_id"], "nonsense")


def test_ends_over_the_group_limit(spark, monkeypatch):
    from wattline.operators import ordering

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("series_id"), F.timestamp_seconds("id").alias("ts"))
    ends = lambda: [sorted(map(str, f.collect())) for f in (ordering.tail(df, 700, skip=5), ordering.head(df, 900))]
    few = ends()
    monkeypatch.setattr(ordering, "GROUP_LIMIT_ROWS", 10)
    assert ends() == few and len(few[0]) == 1400 and len(few[1]) == 1800
