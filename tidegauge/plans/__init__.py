"""Registered queries, one module per section of the operator inventory."""

from importlib import import_module

MODULES = [
    "align_queries",
    "window_queries",
    "scalar_queries",
    "feature_queries",
    "composite_queries",
    "metric_queries",
    "calibration_queries",
    "selection_queries",
    "backtest_queries",
    "serving_queries",
    "model_queries",
    "stream_queries",
]


def load_all() -> None:
    for name in MODULES:
        import_module(f"tidegauge.plans.{name}")
