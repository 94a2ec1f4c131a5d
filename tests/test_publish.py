"""Published versions: one order, whole or not at all."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from wattline.sources import results


def rows(spark, value, names="ab"):
    return spark.createDataFrame([(n, value) for n in names], "series_id string, v long")


def test_publishers_at_once(spark, tmp_path):
    """Eight publishers race: eight versions with numbers of their own, one latest per series."""
    path = str(tmp_path / "published")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: results.publish(rows(spark, k), path, run_id=f"r{k}"), range(8)))
    assert sorted(numbers) == list(range(1, 9))
    latest = results.read_latest(spark, path).collect()
    assert sorted(r.series_id for r in latest) == ["a", "b"] and {r.v for r in latest} == {numbers.index(8)} and {r.version for r in latest} == {8}
    assert results.read_versions(spark, path).count() == 16
    assert results.publish(rows(spark, 99), path, run_id="r3") == 9
    again = results.read_versions(spark, path)
    assert again.count() == 16 and {r.version for r in again.filter("run_id = 'r3'").collect()} == {9} and spark.read.parquet(path).count() == 16


def test_torn_writes_are_not_read(spark, tmp_path):
    path = str(tmp_path / "published")
    with pytest.raises(ValueError, match="nothing is published"):
        results.read_latest(spark, path)
    results.publish(rows(spark, 1), path, run_id="one")

    def broken(v):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        results.publish(rows(spark, 2).withColumn("v", F.udf(broken, "long")("v")), path, run_id="two")
    rows(spark, 3).withColumns({"run_id": F.lit("x"), "created_at": F.current_timestamp()}).write.parquet(f"{path}/folder=x")
    (tmp_path / "published" / "_log" / ".half").write_text("{")
    assert {(r.series_id, r.v) for r in results.read_latest(spark, path).collect()} == {("a", 1), ("b", 1)}
    assert results.publish(rows(spark, 4, "b"), path, run_id="three") == 2
    assert {(r.series_id, r.v) for r in results.read_latest(spark, path).collect()} == {("a", 1), ("b", 4)}


def test_a_taken_number_is_not_replaced(spark, tmp_path):
    name = str(tmp_path / "log" / "1.json")
    assert results._put_new(spark, name, "one") and not results._put_new(spark, name, "two")
    assert open(name).read() == "one" and [p.name for p in (tmp_path / "log").iterdir() if not p.name.endswith(".crc")] == ["1.json"]
