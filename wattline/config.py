"""Defaults as one frozen dataclass; pass ``replace(DEFAULTS, ...)`` to change them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace  # noqa: F401  (replace is re-exported)


@dataclass(frozen=True)
class Config:
    # Defaults that decide results.
    max_rows: int = 50_000
    start_date: str = "2015-01-01"
    end_date: str = "2020-12-31"
    min_rows: int = 100
    missing_strategy: str = "interpolate"
    interpolate_limit: int = 6
    outlier_method: str = "iqr"
    outlier_threshold: float = 3.0
    iqr_multiplier: float = 1.5
    lags: tuple[int, ...] = (1, 2, 3, 24, 25, 48, 49, 168, 169)
    windows: tuple[int, ...] = (7, 24, 30, 168)
    holiday_country: str = "DE"
    test_size: float = 0.2
    seed: int = 42
    horizons: dict[str, int] = field(default_factory=lambda: {"24h": 24, "7d": 168, "30d": 720})
    stat_train_rows: int | None = None
    stat_test_rows: int | None = None
    anomaly_methods: tuple[str, ...] = ("zscore", "iqr", "isolation_forest", "lof", "one_class_svm")
    zscore_threshold: float = 3.0
    contamination: float = 0.05
    forest_trees: int = 100
    lof_neighbors: int = 20
    svm_nu: float = 0.05
    explain_rows: int | None = None
    background_rows: int | None = None
    peak_hours: tuple[int, ...] = (15, 16, 17, 18)
    high_percentile: float = 0.90
    load_shift_threshold: float = 5_000.0


DEFAULTS = Config()
