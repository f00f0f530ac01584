"""Threshold tuning and risk-score calibration on a validation split.

A grid search does not revisit the rows once per grid point.  Each row contributes the
number of thresholds it reaches, rows are counted by that number, and the confusion counts
of every threshold are running sums over at most (grid size + 1) bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import scores
from . import ordering, reports


def threshold_sweep(df: DataFrame, reached: Column, steps: tuple[int, int], per_unit: int,
                    label: str = "is_true_threat", by: Sequence[str] = (),
                    target: Column | None = None) -> DataFrame:
    """Confusion counts and rates of every threshold i / per_unit, i in steps (inclusive).

    `reached` is how many thresholds the row is flagged at (see `scores.grid_rank`).
    """
    first, last = steps
    hit = F.lit(False) if target is None else F.coalesce(target, F.lit(False))
    bins = df.groupBy(*by, reached.alias("_n")).agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"),
        F.count_if(hit).alias("tgt"))
    packed = bins.groupBy(*by).agg(
        F.collect_list(F.struct("_n", "pos", "neg", "tgt")).alias("_bins"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_q"), F.sum("tgt").alias("_t"))
    grid = packed.withColumn("step", F.explode(F.sequence(F.lit(first), F.lit(last))))

    def above(field):
        kept = F.filter("_bins", lambda b: b["_n"] > F.col("step") - F.lit(first))
        return F.aggregate(kept, F.lit(0).cast("bigint"), lambda s, b: s + b[field])

    counted = grid.select(
        *by, "step", (F.col("step") / F.lit(float(per_unit))).alias("tau"), above("pos").alias("tp"),
        above("neg").alias("fp"), above("tgt").alias("target_hits"), "_p", "_q",
        F.col("_t").alias("target_size"))
    return reports.with_rates(counted.withColumns(
        {"fn": F.col("_p") - F.col("tp"), "tn": F.col("_q") - F.col("fp")}).drop("_p", "_q"))


def alpha_grid() -> Column:
    """alpha = 5 i / 100 from integers, never accumulated."""
    return F.transform(F.sequence(F.lit(fv.ALPHA_STEPS[0]), F.lit(fv.ALPHA_STEPS[1])),
                       lambda i: i * 5 / F.lit(100.0))


def hybrid_sweep(val: DataFrame, target: str | None = None) -> DataFrame:
    """Every (alpha, tau) of the fusion grid."""
    exploded = val.withColumn("alpha", F.explode(alpha_grid()))
    reached = scores.grid_rank(scores.fuse("a_lstm", "a_if", F.col("alpha")), 100, *fv.TAU_STEPS)
    return threshold_sweep(exploded, reached, fv.TAU_STEPS, 100, by=["alpha"],
                           target=None if target is None else F.col("threat_class") == target)


def first_best(sweep: DataFrame, fields: Sequence[str], order: Sequence[Column], defaults: dict,
               by: Sequence[str] = ()) -> DataFrame:
    """Arg-extremum in the given order; without candidates the default row."""
    best = sweep.groupBy(*by).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_b"))
    return best.select(*by, *[F.coalesce(F.col("_b")[f], F.lit(defaults[f])).alias(f) for f in fields])


def tune_ewma(val: DataFrame) -> DataFrame:
    """tau with the best F1 of `deviation > tau`; the lowest wins ties."""
    reached = scores.grid_rank("ewma_deviation", 4, *fv.EWMA_TAU_STEPS, strict=True)
    sweep = threshold_sweep(val, reached, fv.EWMA_TAU_STEPS, 4)
    return first_best(sweep, ["tau", "f1"], [-F.col("f1"), F.col("step")],
                      {"tau": fv.LEGACY_EWMA_TAU, "f1": -1.0})


def tune_hybrid(val: DataFrame) -> DataFrame:
    """(alpha, tau) with the best F1; ties go to the lowest alpha, then the lowest tau."""
    return first_best(hybrid_sweep(val), ["alpha", "tau", "f1"],
                      [-F.col("f1"), F.col("alpha"), F.col("step")],
                      {"alpha": fv.FALLBACK_ALPHA, "tau": fv.HYBRID_FLAG_THRESHOLD, "f1": -1.0})


def best_tau_per_alpha(val: DataFrame) -> DataFrame:
    return first_best(hybrid_sweep(val), ["tau", "f1"], [-F.col("f1"), F.col("step")],
                      {"tau": 0.5, "f1": -1.0}, ["alpha"])


def tune_recall(val: DataFrame, target: str = "malicious_insider", budget: float = fv.FPR_BUDGET) -> DataFrame:
    """(alpha, tau) with the best recall on one class among points within the false-positive
    budget; ties go to the lower rate, then the first point."""
    sweep = hybrid_sweep(val, target)
    rates = sweep.withColumns({
        "recall": scores.ratio("target_hits", "target_size"),
        "fpr": F.when(F.col("fp") + F.col("tn") > 0, scores.ratio("fp", F.col("fp") + F.col("tn"))).otherwise(1.0)})
    return first_best(rates.filter(F.col("fpr") <= budget), ["alpha", "tau", "recall", "fpr"],
                      [-F.col("recall"), F.col("fpr"), F.col("alpha"), F.col("step")],
                      {"alpha": 1.0, "tau": 0.5, "recall": -1.0, "fpr": 1.0})


# --- risk-score calibration -----------------------------------------------------
def raw_sbrs(s, a, beta) -> Column:
    return scores._c(s) * (F.lit(1.0) + scores._c(beta) * scores._c(a)) / F.lit(100.0)


def beta_auc(val: DataFrame, s: str = "s", a: str = "a_hybrid", betas=fv.BETAS) -> DataFrame:
    """AUC of the risk score against the threat label for every beta."""
    long = val.select("is_true_threat", s, a, F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta"))
    valued = long.withColumn("v", raw_sbrs(s, a, F.col("beta")))
    return ordering.rank_auc(valued, "v", "is_true_threat", ["beta"], few_groups=True)


def knee(curve: DataFrame, share: float = fv.KNEE_SHARE) -> DataFrame:
    """Smallest beta reaching `share` of the best AUC."""
    best = curve.agg(F.max("auc")).scalar()
    return curve.filter(F.col("auc") >= F.lit(share) * best).agg(F.min("beta").alias("beta"))


def derive_bands(val: DataFrame, beta, s: str = "s", a: str = "a_hybrid") -> DataFrame:
    """Cut points: the 95 % and 99.5 % quantiles of the benign risk score."""
    benign = val.filter(~F.col("is_true_threat")).withColumn("v", raw_sbrs(s, a, beta))
    alert, block = fv.BAND_QUANTILES
    return ordering.quantiles(benign, "v", {"t_alert": alert, "t_block": block})


def score_percentiles(val: DataFrame, beta, s: str = "s", a: str = "a_hybrid") -> DataFrame:
    """Benign 50/90/99 and threat 10/50/90 percentiles of the risk score."""
    valued = val.withColumn("v", raw_sbrs(s, a, beta))
    q = ordering.quantiles(valued, "v", {f"p{p}": p / 100 for p in (10, 50, 90, 99)}, ["is_true_threat"],
                           few_groups=True)
    return q.select("is_true_threat", F.when(F.col("is_true_threat"), F.col("p10")).alias("p10"), "p50", "p90",
                    F.when(~F.col("is_true_threat"), F.col("p99")).alias("p99"))


def calibrated_configs(beta: Column, bands: DataFrame) -> dict[str, tuple]:
    cut = bands.select(F.struct("*")).scalar()
    return {"new_calibrated": (beta, cut["t_alert"], cut["t_block"]),
            "old_bands": (fv.OLD_BETA, *fv.OLD_CUTS), "doc_bands": (fv.OLD_BETA, *fv.DOC_CUTS)}
