"""Ratcliff-Obershelp similarity of normalised strings, vectorised over Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F, types as T

from .text import fold


def normalised_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def length_bound(a: str, b: str) -> float:
    """Upper bound of the ratio from the lengths alone."""
    total = len(a) + len(b)
    return 2.0 * min(len(a), len(b)) / total if total else 0.0


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([normalised_ratio(fold(x), fold(y)) for x, y in zip(a, b)], dtype=float)
