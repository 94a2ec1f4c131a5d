"""Canonical table schemas."""

from pyspark.sql import types as T

# Place of a record's line among all uploads.
UPLOAD_ORDER = T.StructType([
    T.StructField("uploaded_at", T.TimestampType()),
    T.StructField("file", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("line", T.LongType()),
])

ENERGY_RECORD = T.StructType([
    T.StructField("series_id", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("value", T.DoubleType(), False),
    T.StructField("unit", T.StringType(), False),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("ingest_order", UPLOAD_ORDER, True),
])

FORECAST_POINT = T.StructType([
    T.StructField("forecast", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
])

FORECAST_RUN = T.StructType([
    T.StructField("series_id", T.StringType(), False),
    T.StructField("run_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("model", T.StringType()),
    T.StructField("horizon", T.StringType(), False),
    T.StructField("forecast_data", T.MapType(T.StringType(), FORECAST_POINT)),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("mape", T.DoubleType()),
])

RECOMMENDATION = T.StructType([
    T.StructField("series_id", T.StringType(), False),
    T.StructField("rule_no", T.IntegerType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("priority", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("estimated_saving_pct", T.DoubleType(), False),
    T.StructField("action_items", T.ArrayType(T.StringType()), False),
])
