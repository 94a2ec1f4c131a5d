"""Seeded hourly series as DataFrames."""

import numpy as np
import pandas as pd

SCHEMA = "series_id string, ts timestamp_ntz, y double"


def raw(n=600, seed=0, start="2020-01-01", exog=True, series="s"):
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    pdf = pd.DataFrame({
        "series_id": series, "ts": pd.date_range(start, periods=n, freq="h"),
        "y": 50000 + 10000 * np.sin(2 * np.pi * i / 24) + 3000 * np.sin(2 * np.pi * i / 168) + rng.normal(0, 1200, n),
    })
    if exog:
        pdf["solar"] = np.maximum(0, rng.normal(5000, 2500, n))
        pdf["wind"] = np.maximum(0, rng.normal(20000, 6000, n))
    return pdf


def frame(spark, pdf):
    extra = [c for c in pdf.columns if c not in ("series_id", "ts", "y")]
    schema = SCHEMA + "".join(f", {c} {'long' if pdf[c].dtype.kind == 'i' else 'double'}" for c in extra)
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    return spark.createDataFrame([[r[0], r[1].to_pydatetime(), *r[2:]] for r in rows], schema)


def spikes(seed=42, n=500, at=(50, 150, 300, 400), level=300000, sd=2500):
    rng = np.random.default_rng(seed)
    y = rng.normal(50000, sd, n)
    y[list(at)] = level
    return pd.DataFrame({"series_id": "s", "ts": pd.date_range("2020-01-01", periods=n, freq="h"), "y": y})


def sorted_pdf(df, by=("series_id", "ts")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)
