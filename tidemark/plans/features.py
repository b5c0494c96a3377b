"""Feature plug-ins, ordered folds and per-window user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

FeatureFn = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Feature:
    id: str
    ver: int
    warmup: int
    offline: bool
    fn: FeatureFn


_FEATURES: dict[str, Feature] = {}


def register_feature(id: str, ver: int, warmup: int, locality: str, fn: FeatureFn) -> Feature:
    """``locality``: Online, or Offline for one that needs a whole batch."""
    if locality not in ("Online", "Offline"):
        raise ValueError(f"unknown locality: {locality}")
    if id in _FEATURES:
        raise ValueError(f"feature exists: {id}")
    _FEATURES[id] = Feature(id, ver, warmup, locality == "Offline", fn)
    return _FEATURES[id]


def apply_feature(id: str, df: DataFrame) -> DataFrame:
    f = _FEATURES[id]
    if f.offline and df.isStreaming:
        raise ValueError(f"{id} needs a batch")
    return f.fn(df)


def per_window(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's fit and apply over each walk-forward window (see ``study.walk_forward``)."""
    return df.groupBy("window_id").applyInPandas(fn, schema)
