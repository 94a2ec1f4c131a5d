"""The order of lines in files, through uploads, cleaning and runs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattline.operators import cleaning
from wattline.plans import runs
from wattline.sources import csv, records

START = datetime(2020, 1, 1)


def write(folder, name, lines, header="utc_timestamp,load"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *lines]) + "\n")


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def stamp(k):
    return (START + timedelta(hours=k)).strftime("%Y-%m-%d %H:%M:%S")


def test_first_line_stays_over_splits_and_files(spark, tmp_path, small_splits):
    lines = [f"{stamp(k % 300)},{k}" for k in range(1500)]
    write(tmp_path / "in", "b.csv", lines[700:])
    write(tmp_path / "in", "a.csv", lines[:700])
    df = csv.load(spark, str(tmp_path / "in"), target="load", ingest_order=csv.ORDER)
    assert df.rdd.getNumPartitions() > 5
    ordered = df.orderBy(csv.ORDER).collect()
    assert [r.y for r in ordered] == list(map(float, range(1500)))
    kept = cleaning.dedup_first(df, ingest_order=csv.ORDER).orderBy("ts").collect()
    assert [r.y for r in kept] == list(map(float, range(300)))
    capped = csv.load(spark, str(tmp_path / "in"), target="load", max_rows=901, ingest_order=csv.ORDER)
    assert sorted(r.y for r in capped.collect()) == list(map(float, range(901)))


def test_null_first_reading_stays_and_is_filled(spark, tmp_path):
    """The first line of a time counts even if its reading is bad."""
    write(tmp_path / "in", "a.csv", [f"{stamp(0)},1", f"{stamp(1)},bad", f"{stamp(1)},9", f"{stamp(2)},3", "no time,5"])
    df = csv.load(spark, str(tmp_path / "in"), target="load", ingest_order=csv.ORDER)
    assert [r.y for r in cleaning.dedup_first(df, ingest_order=csv.ORDER).orderBy("ts").collect()] == [1.0, None, 3.0]
    cleaned = cleaning.clean(df, ingest_order=csv.ORDER, winsorized=False)
    assert cleaned.columns == ["series_id", "ts", "y"] and [r.y for r in cleaned.orderBy("ts").collect()] == [1.0, 2.0, 3.0]


def test_uploads_keep_their_order(spark, tmp_path):
    """First upload before second; records stored without an order come last, ties by content."""
    write(tmp_path / "one", "z.csv", [f"{stamp(0)},7", f"{stamp(0)},5", f"{stamp(1)},bad", f"{stamp(1)},6"])
    write(tmp_path / "two", "a.csv", [f"{stamp(k)},{k}" for k in range(4)])
    stored = str(tmp_path / "stored")
    old = spark.createDataFrame([("o", START + timedelta(hours=k), float(v), "MW", "old") for k, v in ((0, 1), (4, 2), (4, 1))],
                                "series_id string, ts timestamp, value double, unit string, source_file string")
    records.append_records(old, stored)
    for name in ("one", "two"):
        csv.upload_file(spark, str(tmp_path / name), stored, owner="o", target="load")
    rows = records.as_series(records.read_records(spark, stored, "o", ordered=True), ingest_order=csv.ORDER)
    assert [r.y for r in cleaning.dedup_first(rows, ingest_order=csv.ORDER).orderBy("ts").collect()] == [7.0, 6.0, 2.0, 3.0, 1.0]
    assert rows.count() == 10 and records.read_records(spark, stored, "o").count() == 10


def test_runs_take_the_order(spark, tmp_path, small_splits):
    lines = [f"{stamp(k)},{100 + k % 24}" for k in range(400)] + [f"{stamp(k)},-5" for k in range(400)]
    write(tmp_path / "in", "a.csv", lines)
    df = csv.load(spark, str(tmp_path / "in"), target="load", ingest_order=csv.ORDER)
    clean, rows, refused = runs.prepare(df, ingest_order=csv.ORDER)
    assert clean.count() == 400 and clean.filter("y < 0").isEmpty() and rows.count() == 231 and refused.isEmpty()
    assert csv.ORDER not in clean.columns
    stages = {r.stage: r.n_rows for r in runs.dry_run(df, ingest_order=csv.ORDER).collect()}
    assert stages == {"loaded": 800, "clean": 400, "features": 231}


def test_a_column_of_that_name_is_refused(spark, tmp_path):
    write(tmp_path / "in", "a.csv", [f"{stamp(0)},1,2"], "utc_timestamp,load,ingest_order")
    with pytest.raises(ValueError, match="ingest_order"):
        csv.read_text_columns(spark, str(tmp_path / "in"), ingest_order="ingest_order")
    assert csv.load(spark, str(tmp_path / "in"), target="load", ingest_order="place").columns == ["series_id", "ts", "y", "place"]


def test_a_large_month_is_no_single_task(spark, tmp_path):
    """The readings of one owner and one month are written by several tasks, and tasks that look for the first of copied times
    are given rows by size: neither takes the whole month."""
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10000"}
    before = {k: spark.conf.get(k) for k in names}
    rows = spark.range(0, 40_000, 1, 8).select(
        F.lit("o").alias("series_id"), (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") % 300).cast("int"))).alias("ts"),
        F.col("id").cast("double").alias("value"), F.struct(F.lit("file").alias("file"), F.lit(0).cast("long").alias("block"), F.col("id").alias("line")).alias(csv.ORDER))
    stored = str(tmp_path / "stored")
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        records.append_records(rows, stored)
        back = spark.read.parquet(stored)
        sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == 40_000 and len(sizes) > 4 and max(sizes) < 20_000
        kept = cleaning.dedup_first(back.coalesce(1), ingest_order=csv.ORDER)
        assert sorted(r.value for r in kept.collect()) == list(map(float, range(300)))
        assert "rebalance" in kept._jdf.queryExecution().optimizedPlan().toString().lower()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
