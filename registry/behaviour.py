"""Queries over activity: sessions, windows, scoring inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.functions import scores, vectors
from driftwarden.operators import ewma, ordering, sessions
from driftwarden.session import stage_table
from registry import Book, fixtures as fx
from registry.fixtures import r6, sql

book = Book()
query = book.query


# --- flagship ----------------------------------------------------------------
@query("enforcement_by_action", sql("""
SELECT base_action, action, count(*) AS sessions, round(avg(sbrs), 6) AS mean_sbrs FROM (
  SELECT CASE WHEN d > 2e0 THEN 'BLOCK' ELSE 'PERMIT' END AS base_action, sbrs,
    CASE WHEN sbrs >= 184e-2 THEN 'BLOCK' WHEN sbrs >= 122e-2 THEN 'ALERT' ELSE 'PERMIT' END AS action
  FROM (SELECT d, s * (1e0 + 25e-1 * greatest(0e0, least(1e0, d / 8e0))) / 100e0 AS sbrs
        FROM lab JOIN ew USING (user_id, hour_index)))
GROUP BY 1, 2""", "lab", "ew"))
def enforcement_by_action(spark, sf_dir):
    run = ewma.ewma_stream(stage_table(fx.hourly_from_events(spark, sf_dir).select("user_id", "hour_index", "s", "x"), "hours"), "x")
    risk = scores.sbrs("s", scores.clamp(F.col("ewma_deviation") / 8.0, 0.0, 1.0))
    return (run.select(F.when(F.col("ewma_deviation") > fv.LEGACY_EWMA_TAU, "BLOCK").otherwise("PERMIT")
                       .alias("base_action"), scores.band_action(risk).alias("action"), risk.alias("sbrs"))
            .groupBy("base_action", "action")
            .agg(F.count(F.lit(1)).alias("sessions"), r6(F.avg("sbrs"), "mean_sbrs")))


# --- sessions and windows ------------------------------------------------------
SESSION_OUT = ["user_id", "hour_index", "calls", "s", "k", "x", "endpoint_class", "file_class",
               "geo_index", "permission_scope_delta", "collaboration_density", "is_true_threat",
               "is_benign_burst", "threat_class", "episode_id", "split", "in_fit", "in_calib"]


@query("hourly_sessions", sql(f"SELECT {', '.join(SESSION_OUT)} FROM lab", "lab"))
def hourly_sessions(spark, sf_dir):
    h = fx.hourly_from_events(spark, sf_dir)
    return sessions.assign_splits(h, sessions.horizon(h)).select(*SESSION_OUT)


@query("hour_grid", sql("""SELECT user_id, count(*) AS hours, sum(calls) AS calls,
    count(*) FILTER (WHERE active) AS active_hours, min("timestamp") AS first_hour,
    max("timestamp") AS last_hour FROM grid GROUP BY user_id""", "grid"))
def hour_grid(spark, sf_dir):
    g = sessions.dense_grid(fx.hourly(spark, sf_dir), fx.GRID_DEFAULTS)
    return g.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("hours"), F.sum("calls").alias("calls"),
        F.count_if("active").alias("active_hours"),
        F.min("timestamp").cast("timestamp_ntz").alias("first_hour"),
        F.max("timestamp").cast("timestamp_ntz").alias("last_hour"))


EWMA_OUT = "user_id, hour_index, round(p, 6) AS ewma_previous, round(n, 6) AS ewma_new, round(d, 6) AS ewma_deviation"


@query("ewma_stream", sql(f"SELECT {EWMA_OUT} FROM ew", "ew"))
def ewma_stream(spark, sf_dir):
    run = ewma.steps(fx.hourly(spark, sf_dir), "x")
    return run.select("user_id", "hour_index", r6("ewma_previous", "ewma_previous"),
                      r6("ewma_new", "ewma_new"), r6("ewma_deviation", "ewma_deviation"))


FEATURE_SQL = "SELECT user_id, hour_index, split, round(time_gap_sec, 6) AS time_gap_sec, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in fv.FEATURES) + " FROM feat"


@query("session_features", sql(FEATURE_SQL, "feat"))
def session_features(spark, sf_dir):
    return sessions.derive_features(fx.grid(spark, sf_dir)).select(
        "user_id", "hour_index", "split", r6("time_gap_sec", "time_gap_sec"),
        *[r6(c, c) for c in fv.FEATURES])


@query("trailing_activity", sql("""SELECT user_id, hour_index, round(activity_rate, 6) AS activity_rate
    FROM feat WHERE active""", "feat"))
def trailing_activity(spark, sf_dir):
    return (sessions.activity_ratio(fx.grid(spark, sf_dir)).filter("active")
            .select("user_id", "hour_index", r6("activity_rate", "activity_rate")))


@query("time_gaps", sql("SELECT user_id, hour_index, round(time_gap_sec, 6) AS time_gap_sec FROM feat WHERE active",
                        "feat"))
def time_gaps(spark, sf_dir):
    return (sessions.time_gaps(fx.grid(spark, sf_dir)).filter("active")
            .select("user_id", "hour_index", r6("time_gap_sec", "time_gap_sec")))


@query("profiled_sessions", sql("""SELECT user_id, hour_index, user_name, department, platform, home
    FROM lab LEFT JOIN prof USING (user_id)""", "lab", "prof"))
def profiled_sessions(spark, sf_dir):
    return (sessions.attach_profile(fx.hourly(spark, sf_dir), fx.profiles(spark, sf_dir))
            .select("user_id", "hour_index", "user_name", "department", "platform", "home"))


STATS = [f"{m}_{i}" for i in range(6) for m in ("mu", "sd")]


@query("personal_stats", sql("SELECT user_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in STATS)
                             + " FROM pstats", "pstats"))
def personal_stats(spark, sf_dir):
    return sessions.personal_stats(fx.features(spark, sf_dir)).select("user_id", *[r6(c, c) for c in STATS])


@query("global_fallback_stats", sql("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in STATS)
                                    + " FROM pstats", "pstats"))
def global_fallback_stats(spark, sf_dir):
    out = sessions.global_stats(sessions.personal_stats(fx.features(spark, sf_dir)))
    return out.select(*[r6(c, c) for c in STATS])


@query("global_scaler", sql("SELECT user_id, hour_index, " + ", ".join(
    f"round(({c} - mu_{i}) / CASE WHEN sd_{i} = 0 THEN 1 ELSE sd_{i} END, 6) AS g_{i}"
    for i, c in enumerate(fv.FEATURES)) + " FROM afeat, ascal", "afeat", "ascal"))
def global_scaler(spark, sf_dir):
    f = fx.features(spark, sf_dir)
    out = sessions.global_frame(f, sessions.global_scaler(f), f.filter("active"))
    return out.select("user_id", "hour_index", *[r6(f"g_{i}", f"g_{i}") for i in range(6)])


@query("personal_z_frame", sql("SELECT user_id, hour_index, " + ", ".join(
    f"round(z_{i}, 6) AS z_{i}" for i in range(6)) + " FROM zfr", "zfr"))
def personal_z_frame(spark, sf_dir):
    return fx.z_frame(spark, sf_dir).select("user_id", "hour_index",
                                            *[r6(f"z_{i}", f"z_{i}") for i in range(6)])


VEC_SQL = {"vecs": "SELECT user_id, hour_index, active, in_fit, [z_0, z_1, z_2, z_3, z_4, z_5] AS vec FROM zfr"}


def window_digest(window):
    """Position-weighted sum, so that order inside the window counts."""
    weighted = F.transform(window, lambda v, i: (i + 1) * F.aggregate(v, F.lit(0.0), lambda s, x: s + x))
    return F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x)


DIGEST = "list_sum(list_transform(w, lambda v, i: i * list_sum(v)))"


@query("history_windows", sql(f"""SELECT user_id, hour_index, len(w) AS steps, round({DIGEST}, 4) AS digest
    FROM (SELECT *, list(vec) OVER (PARTITION BY user_id ORDER BY hour_index ROWS BETWEEN 23 PRECEDING
    AND CURRENT ROW) AS w FROM vecs) WHERE len(w) = 24 AND active""", "vecs", extra=VEC_SQL))
def history_windows(spark, sf_dir):
    return (sessions.history_windows(fx.z_frame(spark, sf_dir)).filter("active")
            .select("user_id", "hour_index", F.size("window").cast("bigint").alias("steps"),
                    fx.rd(window_digest("window"), 4).alias("digest")))


@query("next_step_targets", sql(f"""SELECT user_id, hour_index, round({DIGEST}, 4) AS digest,
    round(list_sum(nxt), 6) AS target_sum FROM (SELECT *, list(vec) OVER (PARTITION BY user_id ORDER BY
    hour_index ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS w, lead(vec) OVER (PARTITION BY user_id ORDER BY
    hour_index) AS nxt FROM vecs) WHERE len(w) = 24 AND nxt IS NOT NULL AND in_fit""", "vecs", extra=VEC_SQL))
def next_step_targets(spark, sf_dir):
    total = F.aggregate("target", F.lit(0.0), lambda s, x: s + x)
    return (sessions.next_step_targets(fx.z_frame(spark, sf_dir)).filter("in_fit")
            .select("user_id", "hour_index", fx.rd(window_digest("window"), 4).alias("digest"),
                    r6(total, "target_sum")))


@query("prediction_error", sql("""SELECT user_id, hour_index,
    round(list_sum(list_transform(vec, lambda v, i: (v - prev[i]) * (v - prev[i]))) / 6, 6) AS error FROM (
    SELECT *, w[24] AS prev FROM (SELECT *, list(vec) OVER (PARTITION BY user_id ORDER BY hour_index
    ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS w FROM vecs) WHERE len(w) = 24 AND active)""",
    "vecs", extra=VEC_SQL))
def prediction_error(spark, sf_dir):
    """Squared error of the last-hour-repeats predictor."""
    pairs = sessions.prediction_pairs(fx.z_frame(spark, sf_dir)).filter("active")
    return pairs.select("user_id", "hour_index", r6(vectors.mean_squared_error(
        F.element_at("window", -1), F.col("target")), "error"))


@query("padded_windows", sql("""SELECT user_id, hour_index, 23 AS steps, round(list_sum(list_transform(
    w, lambda v, i: (i + 23 - len(w)) * list_sum(v))), 4) AS digest FROM (SELECT *, list(vec) OVER (PARTITION BY
    user_id ORDER BY hour_index ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING) AS w FROM vecs)
    WHERE len(w) > 0 AND active""", "vecs", extra=VEC_SQL))
def padded_windows(spark, sf_dir):
    vecs = fx.z_frame(spark, sf_dir).withColumn("vec", sessions.z_vector())
    hist = F.collect_list("vec").over(sessions.by_user().rowsBetween(-23, -1))
    return (vecs.withColumn("h", hist).filter(F.col("active") & (F.size("h") > 0))
            .withColumn("padded", vectors.left_pad_rows(F.col("h"), 23, 6))
            .select("user_id", "hour_index", F.size("padded").alias("steps"),
                    fx.rd(window_digest("padded"), 4).alias("digest")))


ERROR_SQL = {**VEC_SQL, "err": """SELECT user_id, hour_index, list_sum(list_transform(vec, lambda v, i: (v - prev[i]) * (v - prev[i]))) / 6 AS error FROM (
    SELECT *, w[24] AS prev FROM (SELECT *, list(vec) OVER (PARTITION BY user_id ORDER BY hour_index
    ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS w FROM vecs) WHERE len(w) = 24 AND active)""",
    "errtest": "SELECT round(error, 9) AS v, is_true_threat AS pos FROM err JOIN lab USING (user_id, hour_index) WHERE split = 'test'"}


@query("prediction_error_auc", sql("""SELECT count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg,
    round((sum(CASE WHEN pos THEN r END) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2e0)
    / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM (SELECT *, rank() OVER (ORDER BY v)
    + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS r FROM errtest)""", "errtest", extra=ERROR_SQL))
def prediction_error_auc(spark, sf_dir):
    """Diagnostic: how well the error of the last-hour-repeats predictor separates threats."""
    pairs = sessions.prediction_pairs(fx.z_frame(spark, sf_dir)).filter(F.col("active") & (F.col("split") == "test"))
    error = fx.rd(vectors.mean_squared_error(F.element_at("window", -1), F.col("target")), 9)
    out = ordering.rank_auc(pairs.select(error.alias("error"), "is_true_threat"), "error", "is_true_threat")
    return out.select("n_pos", "n_neg", r6("auc", "auc"))
