"""Calibration of the risk score on a validation split: beta sweep -> knee -> band cuts.

Each step's result is a handful of rows, cut from its lineage before the next step reads it,
as the next step would otherwise repeat the whole sweep inside its own plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators import reports, tuning
from ..session import cut_lineage


@dataclass
class Calibration:
    curve: DataFrame
    bands: DataFrame

    @property
    def beta(self) -> Column:
        return tuning.knee(self.curve).scalar()


def calibrate(val: DataFrame, s: str = "s", a: str = "a_hybrid") -> Calibration:
    curve = cut_lineage(tuning.beta_auc(val, s, a))
    bands = cut_lineage(tuning.derive_bands(val, tuning.knee(curve).scalar(), s, a))
    return Calibration(curve, bands)


def enforcement_by_config(val: DataFrame, test: DataFrame) -> DataFrame:
    """Test-split enforcement under the calibrated, the old and the documented cuts."""
    fit = calibrate(val)
    return reports.enforcement_report(test, tuning.calibrated_configs(fit.beta, fit.bands))
