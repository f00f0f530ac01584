"""Train on the FIT hours, tune on validation, score every session.

Stages are tables in the shared folder: features -> raw scores -> scored sessions, plus the
small model tables (user statistics, banks, forest, scaler, calibrators, parameters, encoder).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..operators import ewma, forest, ordering, scoring, sessions, tuning
from ..session import cut_lineage, stage_table

SCALED = [f"g_{i}" for i in range(len(fv.FEATURES))]
FRAME = [f"z_{i}" for i in range(len(fv.FEATURES))]


@dataclass
class Trained:
    scored: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def bank_tails(zrows: DataFrame, seed: int = 42, cap: int = fv.MEMORY_BANK_CAP) -> DataFrame:
    """FIT windows as unit vectors, reduced to their last hour: all that an event without
    history, whose earlier hours are zero, can correlate with.

    Only the window's length is needed for that: squares of the active hours of the last day
    plus the idle hours' square times their number.
    """
    z = F.array(*FRAME)
    square = F.aggregate(z, F.lit(0.0), lambda s, x: s + x * x)
    day = sessions.by_user().rangeBetween(-(fv.SEQ_LEN - 1), 0)
    idle = F.lit(fv.SEQ_LEN) - F.count(F.lit(1)).over(day)
    sized = zrows.withColumn("_sq", square).withColumn(
        "_len", F.sqrt(F.sum("_sq").over(day) + idle * F.col("idle_z") * F.col("idle_z")))
    fit = sessions.scoreable(sized).filter("in_fit").select(
        "user_id", "hour_index", F.transform(z, lambda x: x / F.greatest(F.col("_len"), F.lit(1e-9))).alias("tail"))
    return ordering.capped_sample(fit, ["user_id", "hour_index"], ["user_id"], cap, seed, bounded_groups=True)


def raw_scores(feats: DataFrame, fit_hours: Column, trees: int = fv.FOREST_TREES, seed: int = 42,
               weights=None, codes: bool = False) -> tuple[DataFrame, dict]:
    """Memory-bank, isolation and EWMA values of every scoreable session.  `codes`: keep the encoded banks for
    events with history; an encoder always needs them."""
    stats = cut_lineage(sessions.session_stats(feats, fit_hours))
    scaler = cut_lineage(sessions.global_scaler(feats))
    zrows = sessions.personal_frame(feats, stats)
    live = sessions.scoreable(feats)
    bank = scoring.session_bank_scores(zrows, seed=seed, weights=weights).withColumnRenamed("raw", "raw_bank")
    fit_rows = sessions.global_frame(feats, scaler, feats.filter("in_fit"))
    grown = cut_lineage(forest.fit_forest(fit_rows, SCALED, ["user_id", "hour_index"], trees=trees, seed=seed))
    isolated = forest.forest_score(sessions.global_frame(feats, scaler, live), grown, SCALED).drop(*SCALED)
    series = ewma.steps(feats, "activity_rate_per_hr").drop("activity_rate_per_hr")
    keys = ["user_id", "hour_index"]
    # scores are few bytes for their rows: no side may be broadcast
    out = isolated.join(bank.hint("merge"), keys).join(series.hint("merge"), keys)
    model = {"user_stats": stats, "scaler": scaler, "forest": grown, "banks": cut_lineage(bank_tails(zrows, seed))}
    if codes or weights is not None:
        model["codes"] = stage_table(scoring.bank_codes(zrows, seed=seed, weights=weights), "codes")
    if weights is not None:
        model["encoder"] = scoring.weight_table(feats.sparkSession, weights)
    return out, model


def train_and_score(active: DataFrame, hours: Column, trees: int = fv.FOREST_TREES, seed: int = 42,
                    weights=None, codes: bool = False) -> Trained:
    """`active`: one row per user and active hour with the features' inputs, labels and splits
    (see `assign_splits`); `hours`: number of hours in the table."""
    feats = stage_table(sessions.session_features(active), "features")
    raw, tables = raw_scores(feats, sessions.split_bounds(hours)["fit_end"], trees, seed, weights, codes)
    raw = stage_table(raw, "raw_scores")
    calib = raw.filter("in_calib")
    cal_a, cal_b = (cut_lineage(scoring.fit_calibrator(calib, c)) for c in ("raw_bank", "raw_if"))
    unit = scoring.calibrate_and_fuse(raw, cal_a, cal_b, "raw_bank", "raw_if", fv.FALLBACK_ALPHA)
    unit = stage_table(unit, "calibrated")
    val = unit.filter(F.col("split") == "val")
    best = cut_lineage(tuning.tune_hybrid(val))
    tau = cut_lineage(tuning.tune_ewma(val))
    params = best.select("alpha", F.col("tau").alias("tau_hybrid")).withColumn(
        "tau_ewma", tau.select("tau").scalar())
    p = scoring.one_row(params)
    fused = unit.withColumn("_p", p)
    fused = fused.withColumn("a_hybrid", F.col("_p.alpha") * F.col("a_lstm")
                             + (F.lit(1.0) - F.col("_p.alpha")) * F.col("a_if"))
    scored = scoring.decide(fused, "s", F.col("_p.tau_ewma"), F.col("_p.tau_hybrid")).drop("_p")
    calibrators = cal_a.withColumn("name", F.lit("bank")).unionByName(cal_b.withColumn("name", F.lit("forest")))
    return Trained(scored, {**tables, "calibrators": calibrators, "params": params})
