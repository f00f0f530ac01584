"""Queries over scored sessions: metric tables, tuning, calibration, order statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.functions import scores
from driftwarden.plans import risk_calibration
from driftwarden.operators import enforcement, ordering, reports, scoring, sessions, sketches, tuning
from driftwarden.session import shared_dir, stage_table
from driftwarden.sources import store
from registry import Book, fixtures as fx
from registry.fixtures import r6, sql

book = Book()
query = book.query

RATE_COLS = ("precision", "recall", "f1", "fpr")
RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END, 6) AS "precision",
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END, 6) AS recall,
    round(CASE WHEN tp > 0 THEN 2e0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))
        ELSE 0e0 END, 6) AS f1,
    round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0e0 END, 6) AS fpr"""


def counts(flag, label="is_true_threat"):
    return (f"count(*) FILTER (WHERE {flag} AND {label}) AS tp, count(*) FILTER (WHERE {flag} AND NOT {label}) AS fp, "
            f"count(*) FILTER (WHERE NOT ({flag}) AND {label}) AS fn, "
            f"count(*) FILTER (WHERE NOT ({flag}) AND NOT {label}) AS tn")


def stacked(flags, name="detector", source="test"):
    return "(" + " UNION ALL ".join(f"SELECT '{k}' AS {name}, {counts(v)} FROM {source}" for k, v in flags.items()) + ")"


SPLITS = {"test": "SELECT * FROM scored WHERE split = 'test'", "val": "SELECT * FROM scored WHERE split = 'val'",
          "val4": "SELECT * REPLACE (round(a_hybrid, 4) AS a_hybrid) FROM scored WHERE split = 'val'",
          "all4": "SELECT * REPLACE (round(a_hybrid, 4) AS a_hybrid) FROM scored",
          "test4": "SELECT * REPLACE (round(a_hybrid, 4) AS a_hybrid) FROM scored WHERE split = 'test'"}


def osql(body, *names, **extra):
    return sql(body, *names, extra={**SPLITS, **extra})


def part(spark, sf_dir, split):
    return fx.scored(spark, sf_dir).filter(F.col("split") == split)


def stored(spark, sf_dir, split=None):
    """Rows as read back from the stored table, where scores carry 4 decimals; without a split all of them."""
    rows = part(spark, sf_dir, split) if split else fx.scored(spark, sf_dir)
    return rows.withColumn("a_hybrid", fx.rd("a_hybrid", 4))


def rounded(df, *cols):
    return df.withColumns({c: fx.rd(c, 6) for c in cols})


# --- scored rows -----------------------------------------------------------------
SCORE_COLS = ("raw_personal", "raw_global", "a_lstm", "a_if", "a_hybrid", "sbrs_value")
FLAG_COLS = ("ewma_flag", "hybrid_flag", "ewma_correct", "hybrid_correct", "base_action", "hybrid_action",
             "sbrs_category")


@query("calibrated_scores", sql("SELECT user_id, hour_index, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in SCORE_COLS) + ", " + ", ".join(FLAG_COLS) + " FROM scored", "scored"))
def calibrated_scores(spark, sf_dir):
    return fx.scored(spark, sf_dir).select("user_id", "hour_index", *[r6(c, c) for c in SCORE_COLS], *FLAG_COLS)


@query("score_calibrators", sql("""SELECT round(plo, 6) AS personal_lo, round(phi, 6) AS personal_hi,
    round(glo, 6) AS global_lo, round(ghi, 6) AS global_hi FROM cal""", "cal"))
def score_calibrators(spark, sf_dir):
    rows = fx.scored(spark, sf_dir).filter("in_calib")
    a, b = scoring.fit_calibrator(rows, "raw_personal"), scoring.fit_calibrator(rows, "raw_global")
    return a.withColumn("g", scoring.one_row(b)).select(
        r6("lo", "personal_lo"), r6("hi", "personal_hi"), r6("g.lo", "global_lo"), r6("g.hi", "global_hi"))


@query("emitted_rows", sql("""SELECT user_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
    round_even(ewma_previous * 1e3, 0) / 1e3 AS ewma_previous, round_even(ewma_new * 1e4, 0) / 1e4 AS ewma_new, round_even(ewma_deviation * 1e4, 0) / 1e4 AS ewma_deviation,
    ewma_flag AS ewma_anomaly_flagged, round_even(a_lstm * 1e4, 0) / 1e4 AS lstm_score, round_even(a_if * 1e4, 0) / 1e4 AS isolation_forest_score,
    round_even(a_hybrid * 1e4, 0) / 1e4 AS hybrid_anomaly_score, hybrid_flag AS hybrid_anomaly_flagged, s AS pii_sensitivity_score,
    round_even(sbrs_value * 1e4, 0) / 1e4 AS sbrs_value, sbrs_category, base_action, hybrid_action, is_true_threat, ewma_correct,
    hybrid_correct, split, threat_class, is_benign_burst, episode_id FROM (SELECT * REPLACE (
    ewma_previous + 1e-9 AS ewma_previous, ewma_new + 1e-9 AS ewma_new, ewma_deviation + 1e-9 AS ewma_deviation) FROM scored)""",
    "scored"))
def emitted_rows(spark, sf_dir):
    # the nudge keeps two-decimal inputs off exact halves, where engines round differently
    s = fx.scored(spark, sf_dir).withColumns(
        {c: F.col(c) + 1e-9 for c in ("ewma_previous", "ewma_new", "ewma_deviation")})
    s = s.withColumns({"time_gap_sec": F.lit(0.0), "activity_rate_per_hr": F.col("calls").cast("double")})
    return enforcement.emit_rows(s).drop("time_gap_sec", "activity_rate_per_hr")


@query("risk_refresh", osql("""SELECT user_id, hour_index, round_even(v * 1e4, 0) / 1e4 AS sbrs_value,
    CASE WHEN v >= 184e-2 THEN 'HIGH-RISK' WHEN v >= 122e-2 THEN 'SENSITIVE' ELSE 'SAFE' END AS sbrs_category,
    CASE WHEN v >= 184e-2 THEN 'BLOCK' WHEN v >= 122e-2 THEN 'ALERT' ELSE 'PERMIT' END AS hybrid_action
    FROM (SELECT *, s * (1e0 + 25e-1 * a_hybrid) / 100e0 AS v FROM all4)""", "all4"))
def risk_refresh(spark, sf_dir):
    """Every stored row, whatever its split."""
    out = enforcement.refresh_risk(stored(spark, sf_dir), "s", "a_hybrid")
    return out.select("user_id", "hour_index", "sbrs_value", "sbrs_category", "hybrid_action")


@query("risk_refresh_metrics", osql(f"SELECT rule, tp, fp, fn, tn, {RATES} FROM " + stacked({
    "hybrid_alert_or_block": "v >= 122e-2", "hybrid_block_only": "v >= 184e-2",
    "doc_bands_alert_or_block": "round_even(v * 1e4, 0) / 1e4 >= 5e-1"}, "rule",
    "(SELECT *, s * (1e0 + 25e-1 * a_hybrid) / 100e0 AS v FROM test4)"), "test4"))
def risk_refresh_metrics(spark, sf_dir):
    """All rows are refreshed, the report is about the test split."""
    out = enforcement.refresh_risk(stored(spark, sf_dir), "s", "a_hybrid").filter("split = 'test'")
    return rounded(reports.detector_table(out, {
        "hybrid_alert_or_block": F.col("hybrid_action") != "PERMIT",
        "hybrid_block_only": F.col("hybrid_action") == "BLOCK",
        "doc_bands_alert_or_block": scores.band_action("sbrs_value", fv.DOC_BANDS) != "PERMIT"}, name="rule"), *RATE_COLS)


@query("output_constraints", sql("""SELECT unnest(['score_in_unit_interval', 'sensitivity_0_100', 'action_matches_band',
    'correct_matches_flag', 'base_action_matches_flag', 'calls_at_least_two']) AS rule, unnest([
    count(*) FILTER (WHERE hour_index % 7 = 1), count(*) FILTER (WHERE hour_index % 7 = 2), count(*) FILTER (WHERE hour_index % 7 = 3),
    count(*) FILTER (WHERE hour_index % 7 = 4), count(*) FILTER (WHERE hour_index % 7 = 5),
    count(*) FILTER (WHERE calls < 2)]) AS violations FROM scored""", "scored"))
def output_constraints(spark, sf_dir):
    """Every rule is broken on purpose in the rows of one hour out of seven."""
    def broken(i, bad, good):
        return F.when(F.col("hour_index") % 7 == i, bad).otherwise(good)

    s = fx.scored(spark, sf_dir).withColumns({
        "hybrid_anomaly_score": broken(1, F.col("a_hybrid") + 1.5, F.col("a_hybrid")),
        "pii_sensitivity_score": broken(2, F.lit(None), F.col("s")),
        "hybrid_action": broken(3, F.lit("NONE"), F.col("hybrid_action")),
        "hybrid_correct": broken(4, ~F.col("hybrid_correct"), F.col("hybrid_correct")),
        "ewma_anomaly_flagged": broken(5, ~F.col("ewma_flag"), F.col("ewma_flag")), "hybrid_anomaly_flagged": F.col("hybrid_flag")})
    rules = {k: make() for k, make in enforcement.CONSTRAINTS.items()}
    return enforcement.stage_checked(s, "emitted", {**rules, "calls_at_least_two": F.col("calls") >= 2})[1]


@query("partition_refresh", osql("""SELECT user_id, hour_index, round_even(v * 1e4, 0) / 1e4 AS sbrs_value,
    CASE WHEN v >= 184e-2 THEN 'HIGH-RISK' WHEN v >= 122e-2 THEN 'SENSITIVE' ELSE 'SAFE' END AS sbrs_category,
    CASE WHEN v >= 184e-2 THEN 'BLOCK' WHEN v >= 122e-2 THEN 'ALERT' ELSE 'PERMIT' END AS hybrid_action
    FROM (SELECT *, s * (1e0 + 25e-1 * a_hybrid) / 100e0 AS v FROM all4)""", "all4"))
def partition_refresh(spark, sf_dir):
    """A table partitioned by split, of which the test part holds outdated risk values; only that part is written again."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"

    def recompute(df):
        return enforcement.refresh_risk(df, "s", "a_hybrid")

    right = recompute(stored(spark, sf_dir)).select("user_id", "hour_index", "split", "s", "a_hybrid", "sbrs_value", "sbrs_category", "hybrid_action")
    stale = right.withColumn("sbrs_value", F.when(F.col("split") == "test", F.col("sbrs_value") + 1).otherwise(F.col("sbrs_value")))
    store.create(stale, path, ["split"])
    store.refresh(spark, path, ["split"], recompute)
    return spark.read.parquet(path).select("user_id", "hour_index", "sbrs_value", "sbrs_category", "hybrid_action")


# --- confusion tables ----------------------------------------------------------------
@query("binary_metrics_by_split", sql(f"SELECT split, tp, fp, fn, tn, {RATES} FROM (SELECT split, "
                                      f"{counts('hybrid_flag')} FROM scored GROUP BY split)", "scored"))
def binary_metrics_by_split(spark, sf_dir):
    return rounded(reports.binary_metrics(fx.scored(spark, sf_dir), "hybrid_flag", "is_true_threat", ["split"]), *RATE_COLS)


@query("model_comparison", osql("""SELECT model, tp, fp, fn, tn, round("precision", 3) AS "precision",
    round(recall, 3) AS recall, round(f1, 3) AS f1, round(fpr, 3) AS fpr, round((tp + tn) / (tp + fp + fn + tn), 3) AS accuracy
    FROM (SELECT *, """ + RATES + " FROM " + stacked(
    {"EWMA (legacy)": "ewma_flag", "Hybrid LSTM + IF": "hybrid_flag"}, "model") + ")", "test"))
def model_comparison(spark, sf_dir):
    return reports.model_comparison(part(spark, sf_dir, "test"))


@query("detector_table", osql(f"SELECT detector, tp, fp, fn, tn, {RATES} FROM " + stacked({
    "ewma_tuned": "ewma_flag", "ewma_legacy_tau": "ewma_deviation > 2e0", "hybrid": "hybrid_flag",
    "lstm_only": "a_lstm >= 75e-2", "if_only": "a_if >= 75e-2"}), "test"))
def detector_table(spark, sf_dir):
    return rounded(reports.flag_level_table(part(spark, sf_dir, "test"), 0.75), *RATE_COLS)


@query("enforcement_rules", osql(f"SELECT rule, tp, fp, fn, tn, {RATES} FROM " + stacked({
    "hybrid_alert_or_block": "hybrid_action <> 'PERMIT'", "hybrid_block_only": "hybrid_action = 'BLOCK'",
    "ewma_base_action_block": "base_action = 'BLOCK'", "doc_bands_alert_or_block": "sbrs_value >= 5e-1"}, "rule"), "test"))
def enforcement_rules(spark, sf_dir):
    return rounded(reports.enforcement_rules(part(spark, sf_dir, "test")), *RATE_COLS)


def wilson(k, n, sign):
    clip = ("greatest(0e0, ", ")") if sign == "-" else ("least(1e0, ", ")")
    p = f"({k} / {n})"
    return (f"{clip[0]}({p} + 38416e-4 / (2e0 * {n})) / (1e0 + 38416e-4 / {n}) {sign} 196e-2 * sqrt({p} * (1e0 - {p}) / {n} "
            f"+ 38416e-4 / (4e0 * {n} * {n})) / (1e0 + 38416e-4 / {n}){clip[1]}")


CLASS_ROWS = [f"{d}_recall{x}" for d in ("hybrid", "ewma") for x in ("", "_lo", "_hi")] + [
    "mean_a_hybrid", "mean_a_lstm", "mean_a_if"]


@query("class_recall", osql("SELECT threat_class, n AS windows, " + ", ".join(
    f"round(k{d[0]} / n, 6) AS {d}_recall, round({wilson('k' + d[0], 'n', '-')}, 6) AS {d}_recall_lo, "
    f"round({wilson('k' + d[0], 'n', '+')}, 6) AS {d}_recall_hi" for d in ("hybrid", "ewma"))
    + """, round(h, 6) AS mean_a_hybrid, round(l, 6) AS mean_a_lstm, round(f, 6) AS mean_a_if FROM (
    SELECT threat_class, count(*) AS n, count(*) FILTER (WHERE hybrid_flag) AS kh, count(*) FILTER (WHERE ewma_flag) AS ke,
    avg(a_hybrid) AS h, avg(a_lstm) AS l, avg(a_if) AS f FROM test WHERE threat_class IS NOT NULL GROUP BY 1)""", "test"))
def class_recall(spark, sf_dir):
    return rounded(reports.class_recall(part(spark, sf_dir, "test")), *CLASS_ROWS)


@query("episode_recall", osql("""SELECT threat_class, count(*) AS episodes, round(avg(CAST(h AS INT)), 6) AS hybrid_episode_recall,
    round(avg(CAST(e AS INT)), 6) AS ewma_episode_recall FROM (SELECT DISTINCT threat_class, episode_id FROM test
    WHERE threat_class IS NOT NULL) JOIN (SELECT episode_id, bool_or(hybrid_flag) AS h, bool_or(ewma_flag) AS e FROM test
    GROUP BY episode_id) USING (episode_id) GROUP BY threat_class""", "test"))
def episode_recall(spark, sf_dir):
    return rounded(reports.episode_recall(part(spark, sf_dir, "test")), "hybrid_episode_recall", "ewma_episode_recall")


AUC_LONG = " UNION ALL ".join(
    f"SELECT '{s}' AS score, '{g}' AS \"group\", {s} AS v, {p} AS pos FROM test WHERE {p} OR NOT is_true_threat"
    for s in ("a_lstm", "a_if", "a_hybrid")
    for g, p in [("all", "is_true_threat")] + [(c, f"coalesce(threat_class = '{c}', false)") for c in fv.THREAT_CLASSES])
AUC_TAIL = """SELECT {keys}, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg,
    round((sum(CASE WHEN pos THEN r END) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2e0)
        / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM (
    SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY v) + (count(*) OVER (PARTITION BY {keys}, v) - 1) / 2e0 AS r
    FROM {src}) GROUP BY {keys}"""


@query("score_auc", osql(AUC_TAIL.format(keys='score, "group"', src=f"({AUC_LONG})"), "test"))
def score_auc(spark, sf_dir):
    return rounded(reports.auc_table(part(spark, sf_dir, "test"), ["a_lstm", "a_if", "a_hybrid"]), "auc")


@query("burst_report", osql("""SELECT count(*) FILTER (WHERE is_benign_burst) AS sessions,
    round(avg(CAST(ewma_flag AS INT)) FILTER (WHERE is_benign_burst), 6) AS ewma_flag_rate,
    round(avg(CAST(hybrid_flag AS INT)) FILTER (WHERE is_benign_burst), 6) AS hybrid_flag_rate,
    round(avg(CAST(ewma_deviation > 2e0 AS INT)) FILTER (WHERE is_benign_burst), 6) AS ewma_legacy_flag_rate,
    round(avg(a_lstm) FILTER (WHERE is_benign_burst), 6) AS mean_a_lstm, round(avg(a_if) FILTER (WHERE is_benign_burst), 6) AS mean_a_if,
    round(avg(a_hybrid) FILTER (WHERE is_benign_burst), 6) AS mean_a_hybrid,
    round(avg(sbrs_value) FILTER (WHERE is_benign_burst), 6) AS mean_sbrs_value,
    round(avg(s) FILTER (WHERE is_benign_burst), 6) AS mean_sensitivity,
    round(avg(CAST(ewma_flag AS INT)) FILTER (WHERE NOT is_true_threat AND NOT is_benign_burst), 6) AS plain_fpr_ewma,
    round(avg(CAST(hybrid_flag AS INT)) FILTER (WHERE NOT is_true_threat AND NOT is_benign_burst), 6) AS plain_fpr_hybrid,
    count(*) FILTER (WHERE is_benign_burst AND hybrid_action = 'PERMIT') AS n_permit,
    count(*) FILTER (WHERE is_benign_burst AND hybrid_action = 'ALERT') AS n_alert,
    count(*) FILTER (WHERE is_benign_burst AND hybrid_action = 'BLOCK') AS n_block FROM test""", "test"))
def burst_report(spark, sf_dir):
    out = reports.burst_report(part(spark, sf_dir, "test"))
    return rounded(out, *[c for c in out.columns if c.startswith(("ewma", "hybrid", "mean", "plain"))])


@query("operating_point", osql(f"SELECT *, {RATES} FROM (SELECT {counts('f')}, "
    "round(avg(CAST(f AS INT)) FILTER (WHERE threat_class = 'malicious_insider'), 6) AS target_recall, "
    "round(avg(CAST(f AS INT)) FILTER (WHERE is_benign_burst), 6) AS benign_burst_flag_rate "
    "FROM (SELECT *, 85e-2 * a_lstm + (1e0 - 85e-2) * a_if >= 39e-2 AS f FROM test))", "test"))
def operating_point(spark, sf_dir):
    return rounded(reports.operating_point(part(spark, sf_dir, "test"), 0.85, 0.39), *RATE_COLS,
                   "target_recall", "benign_burst_flag_rate")


@query("action_histogram", osql("SELECT hybrid_action, count(*) AS n FROM scored GROUP BY 1", "scored"))
def action_histogram(spark, sf_dir):
    return reports.action_histogram(fx.scored(spark, sf_dir)).select(
        F.explode("action_counts").alias("hybrid_action", "n"))


@query("mask_composition", sql("""SELECT count(*) FILTER (WHERE split = 'test' AND NOT is_true_threat AND NOT is_benign_burst) AS plain_negatives,
    count(*) FILTER (WHERE split = 'val' AND threat_class = 'malicious_insider') AS val_insiders,
    count(*) FILTER (WHERE split = 'train' AND in_fit AND is_benign_burst) AS fit_bursts,
    count(*) FILTER (WHERE in_calib AND is_true_threat) AS calib_threats FROM lab""", "lab"))
def mask_composition(spark, sf_dir):
    y, b, s = F.col("is_true_threat"), F.col("is_benign_burst"), F.col("split")
    return fx.labelled(spark, sf_dir).agg(
        F.count_if((s == "test") & ~y & ~b).alias("plain_negatives"),
        F.count_if((s == "val") & (F.col("threat_class") == "malicious_insider")).alias("val_insiders"),
        F.count_if((s == "train") & F.col("in_fit") & b).alias("fit_bursts"),
        F.count_if(F.col("in_calib") & y).alias("calib_threats"))


# --- counts and summaries -----------------------------------------------------------
@query("session_counts", sql("""SELECT split, threat_class, grouping(split, threat_class) AS level, count(*) AS sessions,
    count(*) FILTER (WHERE is_true_threat) AS positives, count(*) FILTER (WHERE is_benign_burst) AS benign_bursts,
    count(DISTINCT episode_id) AS episodes FROM lab GROUP BY ROLLUP (split, threat_class)""", "lab"))
def session_counts(spark, sf_dir):
    return reports.session_counts(fx.labelled(spark, sf_dir))


@query("dataset_totals", sql("""SELECT count(DISTINCT user_id) AS users, count(*) AS grid_rows, count(*) FILTER (WHERE active) AS active_sessions,
    count(*) FILTER (WHERE active AND hour_index >= 23) AS scoreable_sessions,
    count(*) FILTER (WHERE active AND hour_index < 23) AS dropped_no_history,
    count(*) FILTER (WHERE active AND is_true_threat) AS positives,
    round(avg(CASE WHEN active THEN CAST(is_true_threat AS INT) END), 6) AS positive_rate FROM grid""", "grid"))
def dataset_totals(spark, sf_dir):
    return rounded(reports.dataset_totals(fx.grid(spark, sf_dir)), "positive_rate")


@query("split_bounds", sql("""SELECT split, in_fit, in_calib, min(hour_index) AS first_hour, max(hour_index) AS last_hour, count(*) AS sessions
    FROM lab GROUP BY ALL""", "lab"))
def split_bounds(spark, sf_dir):
    return (fx.labelled(spark, sf_dir).groupBy("split", "in_fit", "in_calib")
            .agg(F.min("hour_index").alias("first_hour"), F.max("hour_index").alias("last_hour"),
                 F.count(F.lit(1)).alias("sessions")))


@query("scoreable_sessions", sql("""SELECT user_id, count(*) FILTER (WHERE hour_index >= 23) AS scoreable, count(*) AS active
    FROM lab GROUP BY user_id""", "lab"))
def scoreable_sessions(spark, sf_dir):
    g = fx.grid(spark, sf_dir)
    kept = sessions.scoreable(g).groupBy("user_id").agg(F.count(F.lit(1)).alias("scoreable"))
    live = g.filter("active").groupBy("user_id").agg(F.count(F.lit(1)).alias("active"))
    return live.join(kept, "user_id", "left").select("user_id", F.coalesce("scoreable", F.lit(0)).alias("scoreable"), "active")


@query("split_tables", sql("SELECT split, count(*) AS sessions, count(DISTINCT user_id) AS users FROM lab GROUP BY split", "lab"))
def split_tables(spark, sf_dir):
    """Three filtered tables put together again by name."""
    lab = fx.labelled(spark, sf_dir)
    parts = [lab.filter(F.col("split") == s).agg(F.lit(s).alias("split"), F.count(F.lit(1)).alias("sessions"),
                                                 F.count_distinct("user_id").alias("users")) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("distinct_episodes", sql("SELECT DISTINCT user_id, episode_id FROM lab WHERE is_true_threat", "lab"))
def distinct_episodes(spark, sf_dir):
    return fx.labelled(spark, sf_dir).filter("is_true_threat").select("user_id", "episode_id").distinct()


BOX = ("ewma_norm", "a_hybrid", "sbrs_value")


@query("score_box_summary", osql(" UNION ALL ".join(f"""SELECT '{c}' AS score, is_true_threat AS label, round(min({c}), 6) AS min,
    round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3,
    round(max({c}), 6) AS max, round(avg({c}), 6) AS mean FROM normed GROUP BY is_true_threat""" for c in BOX), "normed",
    normed="SELECT *, ewma_new / (SELECT max(ewma_new) FROM test) AS ewma_norm FROM test"))
def score_box_summary(spark, sf_dir):
    t = reports.normalise_by_max(part(spark, sf_dir, "test"), "ewma_new", "ewma_norm")
    return rounded(reports.box_summary(t, BOX, "is_true_threat"), "min", "q1", "median", "q3", "max", "mean")


@query("normalised_ewma", osql("""SELECT user_id, hour_index, round(ewma_new / (SELECT max(ewma_new) FROM test), 6) AS ewma_norm
    FROM test""", "test"))
def normalised_ewma(spark, sf_dir):
    t = reports.normalise_by_max(part(spark, sf_dir, "test"), "ewma_new", "ewma_norm")
    return t.select("user_id", "hour_index", r6("ewma_norm", "ewma_norm"))


@query("latency_summary", """SELECT event_type, count(*) AS n_calls, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
    round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(max(value), 6) AS max_ms
    FROM events GROUP BY event_type""")
def latency_summary(spark, sf_dir):
    out = reports.latency_summary(fx.table(spark, sf_dir, "events"), "value", ["event_type"])
    return rounded(out, "mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")


@query("latency_from_sketches", """SELECT user_id, count(*) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max,
    round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events
    WHERE ts >= (SELECT date_trunc('day', min(ts)) FROM events) + INTERVAL 3 DAY GROUP BY user_id""")
def latency_from_sketches(spark, sf_dir):
    """Latencies per user over a range of days, from a stored table of sketches per user and day, without the events."""
    e = fx.activity(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    parts = stage_table(sketches.sketched(e, ["value"], ["user_id", "day"]), "sketches")
    start = parts.agg(F.min("day") + F.expr("INTERVAL 3 DAY")).scalar()
    users = sketches.merged(parts.filter(F.col("day") >= start), ["value"], ["user_id"])
    return rounded(sketches.report(users, "value", {"p50": 0.5, "p95": 0.95}, ["user_id"]).drop("mean"), "min", "max", "p50", "p95")


@query("joint_summary", osql("""SELECT g AS "group", count(*) AS n, round(avg(s), 6) AS mean_s, round(avg(a_hybrid), 6) AS mean_a FROM (
    SELECT s, a_hybrid, unnest(list_filter([CASE WHEN NOT is_true_threat AND NOT is_benign_burst THEN 'normal benign' END,
    CASE WHEN is_benign_burst THEN 'benign burst' END, CASE WHEN is_true_threat THEN 'threat' END], lambda x: x IS NOT NULL)) AS g
    FROM val) GROUP BY g""", "val"))
def joint_summary(spark, sf_dir):
    return rounded(reports.joint_summary(part(spark, sf_dir, "val")), "mean_s", "mean_a")


# --- tuning ---------------------------------------------------------------------------
BRUTE = f"""SELECT *, {RATES} FROM (SELECT a / 20e0 AS alpha, t / 1e2 AS tau, {counts('f')},
    count(*) FILTER (WHERE f AND threat_class = 'malicious_insider') AS target_hits,
    count(*) FILTER (WHERE threat_class = 'malicious_insider') AS target_size FROM (
    SELECT val.*, a, t, (a * 5 / 1e2) * a_lstm + (1e0 - (a * 5 / 1e2)) * a_if >= t / 1e2 AS f
    FROM val, (SELECT unnest(range(21)) AS a), (SELECT unnest(range(2, 99)) AS t)) GROUP BY a, t)"""


@query("fusion_grid", osql(f"SELECT round(alpha, 2) AS alpha, round(tau, 2) AS tau, tp, fp, fn, tn, target_hits, "
                           f"target_size, \"precision\", recall, f1, fpr FROM ({BRUTE})", "val"))
def fusion_grid(spark, sf_dir):
    out = tuning.hybrid_sweep(part(spark, sf_dir, "val"), "malicious_insider").drop("step")
    return rounded(out, *RATE_COLS).withColumns({"alpha": F.round("alpha", 2), "tau": F.round("tau", 2)})


@query("best_fusion", osql(f"SELECT round(alpha, 2) AS alpha, round(tau, 2) AS tau, f1 FROM ({BRUTE}) ORDER BY f1 DESC, alpha, tau LIMIT 1", "val"))
def best_fusion(spark, sf_dir):
    return rounded(tuning.tune_hybrid(part(spark, sf_dir, "val")), "f1").withColumns(
        {"alpha": F.round("alpha", 2), "tau": F.round("tau", 2)})


@query("best_tau_per_alpha", osql(f"""SELECT round(alpha, 2) AS alpha, round(tau, 2) AS tau, f1 FROM (SELECT *, row_number() OVER (
    PARTITION BY alpha ORDER BY f1 DESC, tau) AS rn FROM ({BRUTE})) WHERE rn = 1""", "val"))
def best_tau_per_alpha(spark, sf_dir):
    return rounded(tuning.best_tau_per_alpha(part(spark, sf_dir, "val")), "f1").withColumns(
        {"alpha": F.round("alpha", 2), "tau": F.round("tau", 2)})


@query("recall_operating_point", osql(f"""SELECT round(alpha, 2) AS alpha, round(tau, 2) AS tau, round(target_hits / target_size, 6) AS recall, fpr
    FROM (SELECT * EXCLUDE (recall) FROM ({BRUTE})) WHERE fp / (fp + tn) <= 5e-2
    ORDER BY target_hits DESC, fp, alpha, tau LIMIT 1""", "val"))
def recall_operating_point(spark, sf_dir):
    return rounded(tuning.tune_recall(part(spark, sf_dir, "val")), "recall", "fpr").withColumns(
        {"alpha": F.round("alpha", 2), "tau": F.round("tau", 2)})


@query("best_ewma_threshold", osql(f"""SELECT tau, f1 FROM (SELECT tau, {RATES} FROM (SELECT t / 4e0 AS tau, {counts('ewma_deviation > t / 4e0')}
    FROM val, (SELECT unnest(range(1, 49)) AS t) GROUP BY t)) ORDER BY f1 DESC, tau LIMIT 1""", "val"))
def best_ewma_threshold(spark, sf_dir):
    return rounded(tuning.tune_ewma(part(spark, sf_dir, "val")), "f1")


# --- risk calibration ---------------------------------------------------------------------
BETA_SQL = {
    "betas": f"SELECT unnest([{', '.join(f'{b:.1f}e0' for b in fv.BETAS)}]) AS beta",
    "curve": AUC_TAIL.format(keys="beta", src="(SELECT beta, is_true_threat AS pos, s * (1e0 + beta * a_hybrid) / 1e2 AS v FROM val4, betas)"),
    "rawcurve": AUC_TAIL.replace("round(", "(").replace(", 6) AS auc", ") AS auc").format(
        keys="beta", src="(SELECT beta, is_true_threat AS pos, s * (1e0 + beta * a_hybrid) / 1e2 AS v FROM val4, betas)"),
    "kneeb": "SELECT min(beta) AS beta FROM rawcurve WHERE auc >= 99e-2 * (SELECT max(auc) FROM rawcurve)",
    "bands": """SELECT quantile_cont(v, 0.95) AS t_alert, quantile_cont(v, 0.995) AS t_block FROM (
        SELECT s * (1e0 + beta * a_hybrid) / 1e2 AS v FROM val4, kneeb WHERE NOT is_true_threat)""",
    "conf": """SELECT 'new_calibrated' AS config, beta, t_alert, t_block FROM kneeb, bands UNION ALL
        SELECT 'old_bands', 5e-1, 2e-1, 6e-1 UNION ALL SELECT 'doc_bands', 5e-1, 5e-1, 1e0"""}


def bsql(body, *names):
    return osql(body, *names, **BETA_SQL)


@query("beta_auc_curve", bsql("SELECT * FROM curve", "curve"))
def beta_auc_curve(spark, sf_dir):
    return rounded(tuning.beta_auc(stored(spark, sf_dir, "val")), "auc")


def calibrated(spark, sf_dir):
    val = stored(spark, sf_dir, "val")
    fit = risk_calibration.calibrate(val)
    return val, fit.beta, fit.bands


@query("calibrated_bands", bsql("SELECT beta, round(t_alert, 6) AS t_alert, round(t_block, 6) AS t_block FROM kneeb, bands", "kneeb", "bands"))
def calibrated_bands(spark, sf_dir):
    _, beta, bands = calibrated(spark, sf_dir)
    return rounded(bands.withColumn("beta", beta), "t_alert", "t_block")


@query("risk_percentiles", bsql("""SELECT is_true_threat, CASE WHEN is_true_threat THEN round(quantile_cont(v, 0.1), 6) END AS p10,
    round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90,
    CASE WHEN NOT is_true_threat THEN round(quantile_cont(v, 0.99), 6) END AS p99 FROM (
    SELECT is_true_threat, s * (1e0 + beta * a_hybrid) / 1e2 AS v FROM val4, kneeb) GROUP BY is_true_threat""", "val4", "kneeb"))
def risk_percentiles(spark, sf_dir):
    val, beta, _ = calibrated(spark, sf_dir)
    return rounded(tuning.score_percentiles(val, beta), "p10", "p50", "p90", "p99")


ENF_RATES = ("auto_alert_or_block_rate", "auto_block_rate", "benign_alert_or_block_rate", "benign_block_rate",
             "threat_permit_rate", "burst_alert_or_block_rate", "burst_block_rate", "flagged_precision",
             "flagged_recall", "flagged_f1", "block_precision", "block_recall", "block_f1")


def _prf(k):
    p, r = f"({k}_tp / ({k}_tp + {k}_fp))", f"({k}_tp / ({k}_tp + {k}_fn))"
    return (f"round(CASE WHEN {k}_tp + {k}_fp > 0 THEN {p} ELSE 0e0 END, 6) AS {k}_precision, "
            f"round(CASE WHEN {k}_tp + {k}_fn > 0 THEN {r} ELSE 0e0 END, 6) AS {k}_recall, "
            f"round(CASE WHEN {k}_tp > 0 THEN 2e0 * {p} * {r} / ({p} + {r}) ELSE 0e0 END, 6) AS {k}_f1")


def _avg(x, cond, name):
    return f"round(avg(CAST({x} AS INT)) FILTER (WHERE {cond}), 6) AS {name}"


@query("enforcement_report", bsql("SELECT *, " + _prf("flagged") + ", " + _prf("block") + " FROM (SELECT config, count(*) AS sessions, "
    + ", ".join([_avg("f", "true", "auto_alert_or_block_rate"), _avg("b", "true", "auto_block_rate"),
                 _avg("f", "NOT is_true_threat", "benign_alert_or_block_rate"), _avg("b", "NOT is_true_threat", "benign_block_rate"),
                 _avg("NOT f", "is_true_threat", "threat_permit_rate"), _avg("f", "is_benign_burst", "burst_alert_or_block_rate"),
                 _avg("b", "is_benign_burst", "burst_block_rate")])
    + ", count(*) FILTER (WHERE NOT f) AS n_permit, count(*) FILTER (WHERE f AND NOT b) AS n_alert, count(*) FILTER (WHERE b) AS n_block, "
    + ", ".join(f"count(*) FILTER (WHERE {x} AND {y}) AS {k}_{n}" for k, fl in (("flagged", "f"), ("block", "b"))
                for n, x, y in (("tp", fl, "is_true_threat"), ("fp", fl, "NOT is_true_threat"),
                                ("fn", f"NOT {fl}", "is_true_threat"), ("tn", f"NOT {fl}", "NOT is_true_threat")))
    + """ FROM (SELECT *, v >= t_alert AS f, v >= t_block AS b FROM (SELECT conf.*, test4.*,
    s * (1e0 + beta * a_hybrid) / 1e2 AS v FROM test4, conf)) GROUP BY config)""", "test4", "conf"))
def enforcement_report(spark, sf_dir):
    _, beta, bands = calibrated(spark, sf_dir)
    out = reports.enforcement_report(stored(spark, sf_dir, "test"), tuning.calibrated_configs(beta, bands))
    return rounded(out, *ENF_RATES)


@query("class_band_recall", bsql("""SELECT threat_class, count(*) AS n, round(avg(CAST(v >= t_alert AS INT)), 6) AS alert_or_block_recall,
    round(avg(CAST(v >= t_block AS INT)), 6) AS block_recall FROM (SELECT *, s * (1e0 + beta * a_hybrid) / 1e2 AS v
    FROM test4, kneeb, bands WHERE threat_class IS NOT NULL) GROUP BY threat_class""", "test4", "kneeb", "bands"))
def class_band_recall(spark, sf_dir):
    _, beta, bands = calibrated(spark, sf_dir)
    cut = scoring.one_row(bands)
    out = reports.class_band_recall(stored(spark, sf_dir, "test"), tuning.raw_sbrs("s", "a_hybrid", beta),
                                    cut["t_alert"], cut["t_block"])
    return rounded(out, "alert_or_block_recall", "block_recall")


# --- order statistics and samples ------------------------------------------------------------
@query("average_ranks", osql("""SELECT DISTINCT value, count(*) OVER (PARTITION BY value) AS n,
    rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2e0 AS avg_rank FROM events"""))
def average_ranks(spark, sf_dir):
    return ordering.average_ranks(fx.table(spark, sf_dir, "events"), "value")


@query("sequential_ids", sql("""SELECT user_id, hour_index, printf('ANOM-%05d', row_number() OVER (ORDER BY user_id, hour_index)) AS event_id FROM lab""", "lab"))
def sequential_ids(spark, sf_dir):
    pos = ordering.positions(fx.hourly(spark, sf_dir), ["user_id", "hour_index"])
    return pos.select("user_id", "hour_index", F.format_string("ANOM-%05d", "position").alias("event_id"))


@query("capped_user_sample", sql("""SELECT user_id, hour_index FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
    md5('7|' || user_id || '|' || hour_index), user_id, hour_index) AS rn FROM lab WHERE in_fit) WHERE rn <= 16""", "lab"))
def capped_user_sample(spark, sf_dir):
    rows = fx.labelled(spark, sf_dir).filter("in_fit")
    return ordering.capped_sample(rows, ["user_id", "hour_index"], ["user_id"], 16, 7).select("user_id", "hour_index")


@query("capped_global_sample", sql("""SELECT user_id, hour_index FROM lab WHERE in_fit ORDER BY
    md5('0|' || user_id || '|' || hour_index), user_id, hour_index LIMIT 512""", "lab"))
def capped_global_sample(spark, sf_dir):
    rows = fx.labelled(spark, sf_dir).filter("in_fit")
    return ordering.capped_sample(rows, ["user_id", "hour_index"], [], fv.GLOBAL_BANK_CAP, 0).select("user_id", "hour_index")


@query("session_row_lookup", sql("""SELECT f.user_id, f.hour_index, round(f.activity_rate, 6) AS activity_rate, c.s AS scored_s FROM feat f
    JOIN scored c ON c.user_id = f.user_id AND c.hour_index = f.hour_index WHERE f.active""", "feat", "scored"))
def session_row_lookup(spark, sf_dir):
    """Re-attach scored rows to their session rows on (user, hour)."""
    f = fx.features(spark, sf_dir).filter("active").select("user_id", "hour_index", r6("activity_rate", "activity_rate"))
    return f.join(fx.scored(spark, sf_dir).select("user_id", "hour_index", F.col("s").alias("scored_s")), ["user_id", "hour_index"])
