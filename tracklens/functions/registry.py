"""Named feature lists, prefixed block expansion and the guard against reporting-only columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

CONTENT = ["x1", "x2"]
HISTORY = ["h_n_firstplays", "h_acc_mean", "h_acc_std", "h_fail_rate", "h_fc_rate", "h_bp_mean", "h_days_span"]
AXES = {"x1": "size axis", "x2": "price axis"}
FORBIDDEN = {"level", "table", "region"}  # reporting coordinates, never features


def block(prefix: str, axes=AXES, kinds=("resp", "slope", "dev")) -> list[str]:
    """Column names of one response block, e.g. h_resp_x1."""
    return [f"{prefix}{k}_{a}" for a in axes for k in kinds]


def guard(cols: list[str]) -> list[str]:
    bad = [c for c in cols if c in FORBIDDEN]
    if bad:
        raise ValueError(f"reporting-only columns used as features: {bad}")
    if len(set(cols)) != len(cols):
        raise ValueError("a feature is named twice")
    return cols


def select_features(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``keys`` + registered features; a missing column is an error here, not a NULL later."""
    absent = [c for c in guard(cols) if c not in df.columns]
    if absent:
        raise KeyError(f"features not in the frame: {absent}")
    return df.select(*keys, *cols)
