"""Metric tables over scored sessions.

Every table is one pass of conditional partial aggregates; detectors, rules and
configurations become columns of that pass and are stacked afterwards, so the scored rows
are never multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import scores
from . import ordering

COUNTS = ("tp", "fp", "fn", "tn")


def confusion_aggs(flag: Column, label: Column, prefix: str = "") -> list[Column]:
    cells = (flag & label, flag & ~label, ~flag & label, ~flag & ~label)
    return [F.count_if(c).alias(prefix + n) for c, n in zip(cells, COUNTS)]


def with_rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and fpr from tp, fp, fn, tn; 0 where the denominator is 0."""
    p, r, f1 = scores.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    out = df.withColumns({"precision": p, "recall": r, "f1": f1})
    return out.withColumn("fpr", scores.ratio("fp", F.col("fp") + F.col("tn"))) if "tn" in df.columns else out


def binary_metrics(df: DataFrame, flag: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return with_rates(df.groupBy(*by).agg(*confusion_aggs(F.col(flag), F.col(label))))


def detector_table(df: DataFrame, flags: dict[str, Column], label: str = "is_true_threat",
                   name: str = "detector") -> DataFrame:
    """One row of confusion counts and rates per named flag."""
    keys = list(flags)
    wide = df.agg(*[a for i, k in enumerate(keys)
                    for a in confusion_aggs(flags[k], F.col(label), f"d{i}_")])
    rows = F.array(*[F.struct(F.lit(k).alias(name), *[F.col(f"d{i}_{c}").alias(c) for c in COUNTS])
                     for i, k in enumerate(keys)])
    return with_rates(wide.select(F.inline(rows)))


def model_comparison(df: DataFrame) -> DataFrame:
    """EWMA against hybrid with accuracy, rounded to 3 dp."""
    flags = {"EWMA (legacy)": F.col("ewma_flag"), "Hybrid LSTM + IF": F.col("hybrid_flag")}
    out = detector_table(df, flags, name="model")
    accuracy = scores.ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    rates = out.withColumn("accuracy", accuracy)
    return rates.select("model", *COUNTS, *[scores.round_even(c, 3).alias(c) for c in
                                            ("precision", "recall", "f1", "fpr", "accuracy")])


def flag_level_table(test: DataFrame, tau_hybrid: float) -> DataFrame:
    return detector_table(test, {
        "ewma_tuned": F.col("ewma_flag"),
        "ewma_legacy_tau": F.col("ewma_deviation") > fv.LEGACY_EWMA_TAU,
        "hybrid": F.col("hybrid_flag"), "lstm_only": F.col("a_lstm") >= tau_hybrid,
        "if_only": F.col("a_if") >= tau_hybrid})


def enforcement_rules(test: DataFrame) -> DataFrame:
    return detector_table(test, {
        "hybrid_alert_or_block": F.col("hybrid_action") != "PERMIT",
        "hybrid_block_only": F.col("hybrid_action") == "BLOCK",
        "ewma_base_action_block": F.col("base_action") == "BLOCK",
        "doc_bands_alert_or_block": scores.band_action("sbrs_value", fv.DOC_BANDS) != "PERMIT"},
        name="rule")


def class_recall(test: DataFrame) -> DataFrame:
    """Window recall with Wilson bounds and mean scores per threat class."""
    out = test.filter(F.col("threat_class").isNotNull()).groupBy("threat_class").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if("hybrid_flag").alias("_kh"),
        F.count_if("ewma_flag").alias("_ke"), F.avg("a_hybrid").alias("mean_a_hybrid"),
        F.avg("a_lstm").alias("mean_a_lstm"), F.avg("a_if").alias("mean_a_if"))
    cols = {}
    for name, k in (("hybrid", "_kh"), ("ewma", "_ke")):
        lo, hi = scores.wilson_bounds(k, "windows")
        cols |= {f"{name}_recall": F.col(k) / F.col("windows"), f"{name}_recall_lo": lo,
                 f"{name}_recall_hi": hi}
    return out.withColumns(cols).drop("_kh", "_ke")


def episode_recall(test: DataFrame) -> DataFrame:
    """Share of episodes per class with at least one flagged session.  Episode detection looks
    at every test session of the episode, as well as those outside the class."""
    episodes = test.filter(F.col("episode_id").isNotNull()).groupBy("episode_id").agg(
        F.collect_set("threat_class").alias("classes"),
        F.bool_or("hybrid_flag").alias("_h"), F.bool_or("ewma_flag").alias("_e"))
    per_class = episodes.select(F.explode("classes").alias("threat_class"), "_h", "_e")
    return per_class.groupBy("threat_class").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg(F.col("_h").cast("double")).alias("hybrid_episode_recall"),
        F.avg(F.col("_e").cast("double")).alias("ewma_episode_recall"))


def auc_table(test: DataFrame, score_cols: Sequence[str], label: str = "is_true_threat",
              classes: Sequence[str] = fv.THREAT_CLASSES) -> DataFrame:
    """AUC of every score, overall and per class, each against all negatives.

    The class counts are weights of one ranking per score, so negatives are ranked once and
    not copied per class.
    """
    groups = {"all": F.col(label), **{c: F.col("threat_class") == c for c in classes}}
    names = {f"pos_{i}": g for i, g in enumerate(groups)}
    long = test.select(label, "threat_class", F.inline(F.array(*[
        F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in score_cols])))
    rows = ordering.running_totals(long, "value", {
        "neg": F.count_if(~F.col(label)),
        **{n: F.count_if(F.coalesce(groups[g], F.lit(False))) for n, g in names.items()}}, ["score"], few_groups=True)
    agg = rows.groupBy("score").agg(F.max("neg_total").alias("n_neg"), *[a for n in names for a in (
        F.sum(F.col(n).cast("double") * (F.col("neg_before") + F.col("neg") / 2)).alias(f"w_{n}"),
        F.max(f"{n}_total").alias(f"t_{n}"))])
    out = agg.select("score", "n_neg", F.inline(F.array(*[
        F.struct(F.lit(g).alias("group"), F.col(f"t_{n}").alias("n_pos"), F.col(f"w_{n}").alias("_w"))
        for n, g in names.items()])))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return out.select("score", "group", "n_pos", "n_neg",
                      F.when(pairs > 0, F.try_divide("_w", pairs)).otherwise(F.lit(float("nan"))).alias("auc"))


def burst_report(test: DataFrame) -> DataFrame:
    """Benign-burst trap: flag rates, mean scores, actions, and the false-positive rate on
    ordinary negatives."""
    burst = F.col("is_benign_burst")
    plain = ~F.col("is_true_threat") & ~burst

    def mean(v, cond):
        return F.avg(F.when(cond, v))

    def rate(flag, cond):
        return mean(flag.cast("double"), cond)

    return test.agg(
        F.count_if(burst).alias("sessions"), rate(F.col("ewma_flag"), burst).alias("ewma_flag_rate"),
        rate(F.col("hybrid_flag"), burst).alias("hybrid_flag_rate"),
        rate(F.col("ewma_deviation") > fv.LEGACY_EWMA_TAU, burst).alias("ewma_legacy_flag_rate"),
        *[mean(F.col(c), burst).alias(f"mean_{c}") for c in ("a_lstm", "a_if", "a_hybrid", "sbrs_value")],
        mean(F.col("s").cast("double"), burst).alias("mean_sensitivity"),
        *([mean(F.col("activity_rate"), burst).alias("mean_activity_rate")] if "activity_rate" in test.columns else []),
        rate(F.col("ewma_flag"), plain).alias("plain_fpr_ewma"),
        rate(F.col("hybrid_flag"), plain).alias("plain_fpr_hybrid"),
        *[F.count_if(burst & (F.col("hybrid_action") == a)).alias(f"n_{a.lower()}")
          for a in ("PERMIT", "ALERT", "BLOCK")])


def action_histogram(df: DataFrame) -> DataFrame:
    """Action -> count map in one row."""
    counts = df.groupBy("hybrid_action").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("hybrid_action", "n")))
    return counts.agg(F.map_from_entries(entries).alias("action_counts"))


def operating_point(test: DataFrame, alpha, tau, target: str = "malicious_insider") -> DataFrame:
    """Confusion, target-class recall and burst flag rate at another (alpha, tau)."""
    flagged = test.withColumn("_f", scores.fuse("a_lstm", "a_if", alpha) >= scores._c(tau))
    f = F.col("_f")
    return with_rates(flagged.agg(
        *confusion_aggs(f, F.col("is_true_threat")),
        F.avg(F.when(F.col("threat_class") == target, f.cast("double"))).alias("target_recall"),
        F.avg(F.when(F.col("is_benign_burst"), f.cast("double"))).alias("benign_burst_flag_rate")))


def enforcement_report(df: DataFrame, configs: dict[str, tuple], s: str = "s", a: str = "a_hybrid") -> DataFrame:
    """PERMIT / ALERT / BLOCK outcome of each (beta, alert cut, block cut) configuration."""
    y, burst, aggs = F.col("is_true_threat"), F.col("is_benign_burst"), []
    cols = {}
    for i, (beta, t_alert, t_block) in enumerate(configs.values()):
        cols[f"c{i}"] = F.struct(
            (F.col(s) * (F.lit(1.0) + scores._c(beta) * F.col(a)) / 100.0).alias("v"),
            scores._c(t_alert).alias("ta"), scores._c(t_block).alias("tb"))
    valued = df.withColumns(cols)
    fields = ["sessions", "auto_alert_or_block_rate", "auto_block_rate", "benign_alert_or_block_rate",
              "benign_block_rate", "threat_permit_rate", "n_permit", "n_alert", "n_block",
              "burst_alert_or_block_rate", "burst_block_rate"]
    cells = [f"{k}_{c}" for k in ("flagged", "block") for c in COUNTS]
    for i in range(len(configs)):
        c = F.col(f"c{i}")
        flagged, block = c["v"] >= c["ta"], c["v"] >= c["tb"]
        alert = flagged & ~block

        def rate(x, cond=None):
            return F.avg(x.cast("double") if cond is None else F.when(cond, x.cast("double")))

        values = [F.count(F.lit(1)), rate(flagged), rate(block), rate(flagged, ~y), rate(block, ~y),
                  rate(~flagged, y), F.count_if(~flagged), F.count_if(alert), F.count_if(block),
                  rate(flagged, burst), rate(block, burst)]
        aggs += [v.alias(f"c{i}_{n}") for v, n in zip(values, fields)]
        aggs += confusion_aggs(flagged, y, f"c{i}_flagged_") + confusion_aggs(block, y, f"c{i}_block_")
    wide = valued.agg(*aggs)
    rows = wide.select(F.inline(F.array(*[F.struct(
        F.lit(name).alias("config"), *[F.col(f"c{i}_{f}").alias(f) for f in fields + cells])
        for i, name in enumerate(configs)])))
    out = {}
    for kind in ("flagged", "block"):
        p, r, f1 = scores.precision_recall(*[F.col(f"{kind}_{c}") for c in ("tp", "fp", "fn")])
        out |= {f"{kind}_precision": p, f"{kind}_recall": r, f"{kind}_f1": f1}
    return rows.withColumns(out)


def class_band_recall(df: DataFrame, value: Column, t_alert, t_block) -> DataFrame:
    rows = df.filter(F.col("threat_class").isNotNull()).withColumns(
        {"_v": value, "_ta": scores._c(t_alert), "_tb": scores._c(t_block)})
    return rows.groupBy("threat_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("_v") >= F.col("_ta")).cast("double")).alias("alert_or_block_recall"),
        F.avg((F.col("_v") >= F.col("_tb")).cast("double")).alias("block_recall"))


def joint_summary(df: DataFrame) -> DataFrame:
    """n, mean S and mean A of ordinary benign, burst and threat sessions.  The three masks
    are counted independently, as a burst may also carry a threat label."""
    y, b = F.col("is_true_threat"), F.col("is_benign_burst")
    groups = F.filter(F.array(F.when(~y & ~b, "normal benign"), F.when(b, "benign burst"),
                              F.when(y, "threat")), lambda g: g.isNotNull())
    return (df.withColumn("group", F.explode(groups)).groupBy("group")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_s"), F.avg("a_hybrid").alias("mean_a")))


def session_counts(grid: DataFrame) -> DataFrame:
    """Sessions, positives, bursts and distinct episodes by split and class, with subtotals."""
    active = grid.filter("active") if "active" in grid.columns else grid
    return active.rollup("split", "threat_class").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("sessions"),
        F.count_if("is_true_threat").alias("positives"),
        F.count_if("is_benign_burst").alias("benign_bursts"),
        F.count_distinct("episode_id").alias("episodes"))


def dataset_totals(grid: DataFrame) -> DataFrame:
    live = F.col("active")
    return grid.agg(
        F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("grid_rows"),
        F.count_if(live).alias("active_sessions"),
        F.count_if(live & (F.col("hour_index") >= fv.SEQ_LEN - 1)).alias("scoreable_sessions"),
        F.count_if(live & (F.col("hour_index") < fv.SEQ_LEN - 1)).alias("dropped_no_history"),
        F.count_if(live & F.col("is_true_threat")).alias("positives"),
        F.avg(F.when(live, F.col("is_true_threat").cast("double"))).alias("positive_rate"))


def box_summary(df: DataFrame, score_cols: Sequence[str], label: str) -> DataFrame:
    """Five-number summary and mean of each score by label."""
    long = df.select(F.col(label).alias("label"), F.inline(F.array(*[
        F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("value")) for s in score_cols])))
    five = ordering.quantiles(long, "value", {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0},
                              ["score", "label"], few_groups=True)
    return five.join(long.groupBy("score", "label").agg(F.avg("value").alias("mean")), ["score", "label"])


def latency_summary(df: DataFrame, ms: str, by: Sequence[str] = ()) -> DataFrame:
    q = ordering.quantiles(df, ms, {"p50_ms": .5, "p95_ms": .95, "p99_ms": .99, "max_ms": 1.0}, by)
    mean = df.groupBy(*by).agg(F.count(ms).alias("n_calls"), F.avg(ms).alias("mean_ms"))
    return mean.join(q, list(by)) if by else mean.withColumn("_q", q.select(F.struct("*")).scalar()).select(
        "n_calls", "mean_ms", "_q.*")


def normalise_by_max(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(column) / df.agg(F.max(column)).scalar())
