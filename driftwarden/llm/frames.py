"""Helpers for Python work over sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame

BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session sends at most `BATCH_ROWS` rows and about `BATCH_BYTES` bytes at once to Python, unless it is set to less.

    Spark's own 64 MB per worker and direction are too much for whole texts and sets where workers have a few hundred MB.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups out of batches sorted by `keys`; a group that goes on is held back."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        codes = pdf[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
        for a, b in zip(starts[:-1], starts[1:]):
            yield pdf.iloc[a:b]
        held = pdf.iloc[starts[-1]:]
    if held is not None and len(held):
        yield held
