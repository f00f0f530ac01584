"""Refresh of stored risk columns, emitted row layout, and output constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import scores
from ..session import stage_observed


def refresh_risk(df: DataFrame, s: str = "pii_sensitivity_score", a: str = "hybrid_anomaly_score",
                 beta=fv.SBRS_BETA, bands=fv.SBRS_BANDS) -> DataFrame:
    """Recompute the risk columns from stored S and A; bands on the unrounded value."""
    return (df.withColumn("_v", scores.sbrs(s, a, beta))
            .withColumns({"sbrs_value": scores.round_even("_v", 4), "sbrs_category": scores.band_category("_v", bands),
                          "hybrid_action": scores.band_action("_v", bands)}).drop("_v"))


def emit_rows(scored: DataFrame) -> DataFrame:
    """Scored sessions in the stored layout with column-specific half-even rounding."""
    value = {
        "time_gap_sec": F.rint("time_gap_sec").cast("bigint"),
        "activity_rate_per_hr": scores.round_even("activity_rate_per_hr", 3),
        "ewma_previous": scores.round_even("ewma_previous", 3), "ewma_new": scores.round_even("ewma_new", 4),
        "ewma_deviation": scores.round_even("ewma_deviation", 4), "ewma_anomaly_flagged": F.col("ewma_flag"),
        "lstm_score": scores.round_even("a_lstm", 4), "isolation_forest_score": scores.round_even("a_if", 4),
        "hybrid_anomaly_score": scores.round_even("a_hybrid", 4), "hybrid_anomaly_flagged": F.col("hybrid_flag"),
        "pii_sensitivity_score": F.col("s").cast("int"), "sbrs_value": scores.round_even("sbrs_value", 4),
        "timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")}
    have = set(scored.columns)
    names = [c for c, _ in fv.COMPARISON_COLUMNS + fv.SCORED_EXTRA_COLUMNS]
    return scored.select(*[value.get(c, F.col(c)).alias(c) for c in names if c in value or c in have])


CONSTRAINTS = {
    "score_in_unit_interval": lambda: F.col("hybrid_anomaly_score").between(0.0, 1.0),
    "sensitivity_0_100": lambda: F.col("pii_sensitivity_score").between(0, 100),
    "action_matches_band": lambda: F.col("hybrid_action") == scores.band_action("sbrs_value"),
    "correct_matches_flag": lambda: F.col("hybrid_correct") == (
        F.col("hybrid_anomaly_flagged") == F.col("is_true_threat")),
    "base_action_matches_flag": lambda: (F.col("base_action") == "BLOCK") == F.col("ewma_anomaly_flagged"),
}


def violations(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Rows breaking each rule; a null counts as broken."""
    rules = rules or {k: make() for k, make in CONSTRAINTS.items()}
    wide = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations"))
                                          for k in rules])))


def stage_checked(df: DataFrame, name: str, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The stage table of `df`, and `violations` as the job that writes it has counted them."""
    rules = rules or {k: make() for k, make in CONSTRAINTS.items()}
    staged, seen = stage_observed(df, name, {k: F.count_if(~F.coalesce(c, F.lit(False))) for k, c in rules.items()})
    return staged, df.sparkSession.createDataFrame([(k, seen[k]) for k in rules], "rule string, violations long")


def check_parameters(alpha: float | None = None, beta: float | None = None, limit: int | None = None) -> None:
    for name, value, lo, hi in (("alpha", alpha, 0, 1), ("beta", beta, 0, 5), ("limit", limit, 1, 1000)):
        if value is not None and not lo <= value <= hi:
            raise ValueError(f"{name} must lie in [{lo}, {hi}], got {value}")
