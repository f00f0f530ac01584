"""Adapters from the test tables to the engine's inputs, once for Spark and once as SQL.

`SQL` holds named common table expressions; `sql(body, *names)` puts the needed ones (with
their own inputs) in front of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwarden import fixed_values as fv
from driftwarden.functions import scores
from driftwarden.operators import ewma, sessions
from driftwarden.session import hash_spread, stage_table

_SHARED: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, times and sizes of the tables in a folder, so that changed tables are read anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files))


def shared(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Stage table written once per application and state of the tables, and read by many reports."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir), name)
    if key not in _SHARED:
        _SHARED[key] = stage_table(build(spark, sf_dir), name)
    return _SHARED[key]


def rd(column, digits: int):
    """Rounding as SQL engines do it on doubles: scale, round, scale back."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column * float(10 ** digits)) / float(10 ** digits)


def r6(column, name: str | None = None):
    out = rd(column, 6)
    return out.alias(name) if name else out


# --- activity and sessions -------------------------------------------------
def activity(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
                    "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


ENDPOINT_OF = {"view": "read", "click": "write", "signup": "share", "error": "delete",
               "purchase": "permission_change"}
CLASS_OF = {"read": "malicious_insider", "write": "malicious_insider",
            "share": "compromised_account", "delete": "negligent_insider",
            "permission_change": "overscoped_thirdparty"}


def hourly(spark, sf_dir) -> DataFrame:
    """The session stage table: raw events are reduced once, everything else starts here."""
    return shared(spark, sf_dir, "sessions", hourly_from_events)


def hourly_from_events(spark, sf_dir) -> DataFrame:
    raw = sessions.hourly_sessions(activity(spark, sf_dir), {
        "s": F.least(F.lit(100), F.floor(F.max("value")).cast("int")),
        "_last": F.max_by(F.struct("k", "event_type"), F.struct("ts", "event_id")), "x": F.round(F.sum("value"), 2),
        "collaboration_density": F.size(F.collect_set("event_type")) / 5.0})
    raw = raw.withColumns({"k": F.col("_last.k"), "event_type": F.col("_last.event_type")})
    k, s = F.col("k"), F.col("s")
    endpoint = scores.lookup("event_type", ENDPOINT_OF, "permission_change")
    threat = (k >= 90) & (s >= 50)
    return raw.select(
        "user_id", "timestamp", "hour_index", "calls", "s", k.alias("k"), "x",
        "collaboration_density", endpoint.alias("endpoint_class"),
        F.when(s >= 75, "restricted").when(s >= 50, "confidential").when(s >= 18, "internal")
        .otherwise("public").alias("file_class"),
        (F.greatest(F.lit(0), k - 89) / 10.0).alias("geo_index"),
        F.when(k % 10 == 7, k / 100.0).otherwise(0.0).alias("permission_scope_delta"),
        threat.alias("is_true_threat"),
        ((F.col("calls") >= 2) & (s < 50)).alias("is_benign_burst"),
        F.when(threat, scores.lookup(endpoint, CLASS_OF)).alias("threat_class"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.date_format("timestamp", "yyyy-MM-dd")).alias("episode_id"))


def labelled(spark, sf_dir) -> DataFrame:
    h = hourly(spark, sf_dir)
    return sessions.assign_splits(h, sessions.horizon(h))


GRID_DEFAULTS = {"s": 0, "k": 0, "x": 0.0, "collaboration_density": 0.0, "endpoint_class": "read",
                 "file_class": "public", "geo_index": 0.0, "permission_scope_delta": 0.0,
                 "is_true_threat": False, "is_benign_burst": False}


def grid(spark, sf_dir) -> DataFrame:
    h = hourly(spark, sf_dir)
    return sessions.assign_splits(sessions.dense_grid(h, GRID_DEFAULTS), sessions.horizon(h))


def features(spark, sf_dir) -> DataFrame:
    """Features of every hour of the grid, partitioned by user.  Those of active hours are a stage table; idle hours, which have
    none but zeros, are made where they are read."""
    live = shared(spark, sf_dir, "features", lambda s, d: sessions.derive_features(grid(s, d)).filter("active"))
    idle = sessions.derive_features(grid(spark, sf_dir)).filter("not active")
    return hash_spread(live, "user_id").withColumn("active", F.lit(True)).unionByName(idle)


def profiles(spark, sf_dir) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"),
                    F.col("c_mktsegment").alias("department"), F.col("n_name").alias("home"),
                    F.when(F.col("c_custkey") % 2 == 0, "Google Drive")
                    .otherwise("Microsoft OneDrive").alias("platform")))


def z_frame(spark, sf_dir) -> DataFrame:
    f = features(spark, sf_dir)
    return sessions.personal_frame(f, sessions.personal_stats(f))


def raw_scored(spark, sf_dir) -> DataFrame:
    """Sessions with two raw anomaly scores that SQL can express: distance of the hourly
    volume from the user's own level, and of the sensitivity from the global level."""
    lab = labelled(spark, sf_dir)
    fit = lab.filter("in_fit")
    own = fit.groupBy("user_id").agg(F.avg("x").alias("mu_x"), F.greatest(
        F.stddev_pop("x"), F.lit(fv.SD_FLOOR)).alias("sd_x"))
    whole = fit.agg(F.struct(F.avg("x").alias("mu_x"), F.stddev_pop("x").alias("sd_x"),
                             F.avg("s").alias("mu_s"), F.stddev_pop("s").alias("sd_s"))).scalar()
    j = (ewma.ewma_stream(lab, "x").join(own, "user_id", "left").withColumn("w", whole))
    return j.select(
        *lab.columns, "ewma_previous", "ewma_new", "ewma_deviation",
        F.abs((F.col("x") - F.coalesce("mu_x", F.col("w.mu_x")))
              / F.coalesce("sd_x", F.col("w.sd_x"))).alias("raw_personal"),
        ((F.col("s") - F.col("w.mu_s")) / F.col("w.sd_s") + F.col("k") / 50.0).alias("raw_global"))


def scored(spark, sf_dir) -> DataFrame:
    from driftwarden.operators import scoring

    def build(spark, sf_dir):
        raw = stage_table(raw_scored(spark, sf_dir), "raw_scores")
        cal = raw.filter("in_calib")
        fused = scoring.calibrate_and_fuse(
            raw, scoring.fit_calibrator(cal, "raw_personal"), scoring.fit_calibrator(cal, "raw_global"),
            "raw_personal", "raw_global", alpha=0.25)
        return scoring.decide(fused, "s", tau_ewma=2.5, tau_hybrid=0.75)

    return shared(spark, sf_dir, "scored", build)


SQL = {
    "bounds": "SELECT date_trunc('hour', min(ts)) AS t0 FROM events",
    "act": """SELECT event_id, ts, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events""",
    "lastev": """SELECT *, date_trunc('hour', ts) AS hour_ts, row_number() OVER (
        PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM act""",
    "rawsess": """SELECT user_id, hour_ts AS "timestamp",
        CAST(date_diff('hour', (SELECT t0 FROM bounds), hour_ts) AS BIGINT) AS hour_index,
        count(*) AS calls, least(100, CAST(floor(max(value)) AS INT)) AS s,
        max(CASE WHEN rn = 1 THEN k END) AS k, max(CASE WHEN rn = 1 THEN event_type END) AS et,
        round(sum(value), 2) AS x, count(DISTINCT event_type) / 5e0 AS collaboration_density
        FROM lastev GROUP BY user_id, hour_ts""",
    "sess": """SELECT user_id, "timestamp", hour_index, calls, s, k, x, collaboration_density,
        CASE et WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'signup' THEN 'share'
            WHEN 'error' THEN 'delete' ELSE 'permission_change' END AS endpoint_class,
        CASE WHEN s >= 75 THEN 'restricted' WHEN s >= 50 THEN 'confidential'
            WHEN s >= 18 THEN 'internal' ELSE 'public' END AS file_class,
        greatest(0, k - 89) / 1e1 AS geo_index,
        CASE WHEN k % 10 = 7 THEN k / 1e2 ELSE 0e0 END AS permission_scope_delta,
        (k >= 90 AND s >= 50) AS is_true_threat, (calls >= 2 AND s < 50) AS is_benign_burst,
        CASE WHEN k >= 90 AND s >= 50 THEN CASE et WHEN 'signup' THEN 'compromised_account'
            WHEN 'error' THEN 'negligent_insider' WHEN 'view' THEN 'malicious_insider'
            WHEN 'click' THEN 'malicious_insider' ELSE 'overscoped_thirdparty' END END AS threat_class,
        CAST(user_id AS VARCHAR) || '-' || strftime("timestamp", '%Y-%m-%d') AS episode_id
        FROM rawsess""",
    "cuts": """SELECT h, train_end, fit_end, floor(h * 85e-2) AS val_end, fit_end + 24 AS calib_lo FROM (
        SELECT h, train_end, floor(train_end * 75e-2) AS fit_end FROM (
        SELECT h, floor(h * 7e-1) AS train_end FROM (SELECT max(hour_index) + 1 AS h FROM sess)))""",
    "lab": """SELECT sess.*, CASE WHEN hour_index < train_end THEN 'train' WHEN hour_index < val_end
        THEN 'val' ELSE 'test' END AS split, hour_index < fit_end AS in_fit,
        (hour_index >= calib_lo AND hour_index < train_end) AS in_calib FROM sess, cuts""",
    "seq": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hour_index) AS rn FROM lab",
    "ew": """SELECT user_id, hour_index, rn, x AS p, x AS n, 0e0 AS d FROM seq WHERE rn = 1
        UNION ALL SELECT q.user_id, q.hour_index, q.rn, e.n, 3e-1 * q.x + 7e-1 * e.n,
        (q.x - e.n) / greatest(e.n, 1e-6) FROM ew e JOIN seq q ON q.user_id = e.user_id AND q.rn = e.rn + 1""",
    "own": """SELECT user_id, avg(x) AS mu_x, greatest(stddev_pop(x), 5e-2) AS sd_x
        FROM lab WHERE in_fit GROUP BY user_id""",
    "whole": """SELECT avg(x) AS wmu, stddev_pop(x) AS wsd, avg(s) AS mu_s, stddev_pop(s) AS sd_s
        FROM lab WHERE in_fit""",
    "raws": """SELECT lab.*, ew.p AS ewma_previous, ew.n AS ewma_new, ew.d AS ewma_deviation,
        abs((x - coalesce(mu_x, wmu)) / coalesce(sd_x, wsd)) AS raw_personal,
        (s - mu_s) / sd_s + k / 5e1 AS raw_global
        FROM lab JOIN ew USING (user_id, hour_index) LEFT JOIN own USING (user_id), whole""",
    "cal": """SELECT quantile_cont(raw_personal, 0.5) AS plo, quantile_cont(raw_personal, 0.995) AS phi,
        quantile_cont(raw_global, 0.5) AS glo, quantile_cont(raw_global, 0.995) AS ghi
        FROM raws WHERE in_calib""",
    "fused": """SELECT *, 25e-2 * a_lstm + (1e0 - 25e-2) * a_if AS a_hybrid FROM (SELECT raws.*,
        greatest(0e0, least(1e0, (raw_personal - plo) / (phi - plo))) AS a_lstm,
        greatest(0e0, least(1e0, (raw_global - glo) / (ghi - glo))) AS a_if FROM raws, cal)""",
    "scored": """SELECT *, CASE WHEN ewma_flag THEN 'BLOCK' ELSE 'PERMIT' END AS base_action,
        CASE WHEN sbrs_value >= 184e-2 THEN 'BLOCK' WHEN sbrs_value >= 122e-2 THEN 'ALERT'
            ELSE 'PERMIT' END AS hybrid_action,
        CASE WHEN sbrs_value >= 184e-2 THEN 'HIGH-RISK' WHEN sbrs_value >= 122e-2 THEN 'SENSITIVE'
            ELSE 'SAFE' END AS sbrs_category,
        ewma_flag = is_true_threat AS ewma_correct, hybrid_flag = is_true_threat AS hybrid_correct
        FROM (SELECT *, ewma_deviation > 25e-1 AS ewma_flag, a_hybrid >= 75e-2 AS hybrid_flag,
        s * (1e0 + 25e-1 * a_hybrid) / 100e0 AS sbrs_value FROM fused)""",
    "grid": """SELECT u.user_id, h.hour_index, (SELECT t0 FROM bounds) + to_hours(h.hour_index) AS "timestamp",
        coalesce(calls, 0) AS calls, calls IS NOT NULL AS active, coalesce(s, 0) AS s,
        coalesce(k, 0) AS k, coalesce(x, 0e0) AS x,
        coalesce(collaboration_density, 0e0) AS collaboration_density,
        coalesce(endpoint_class, 'read') AS endpoint_class, coalesce(file_class, 'public') AS file_class,
        coalesce(geo_index, 0e0) AS geo_index,
        coalesce(permission_scope_delta, 0e0) AS permission_scope_delta,
        coalesce(is_true_threat, false) AS is_true_threat,
        coalesce(is_benign_burst, false) AS is_benign_burst, threat_class, episode_id,
        CASE WHEN h.hour_index < train_end THEN 'train' WHEN h.hour_index < val_end THEN 'val'
            ELSE 'test' END AS split, h.hour_index < fit_end AS in_fit,
        (h.hour_index >= calib_lo AND h.hour_index < train_end) AS in_calib
        FROM (SELECT DISTINCT user_id FROM sess) u, cuts,
        (SELECT unnest(range((SELECT max(hour_index) + 1 FROM sess))) AS hour_index) h
        LEFT JOIN sess ON sess.user_id = u.user_id AND sess.hour_index = h.hour_index""",
    "gaps": """SELECT *, CASE WHEN active THEN epoch("timestamp") - max(CASE WHEN active THEN
        epoch("timestamp") END) OVER (PARTITION BY user_id ORDER BY hour_index ROWS BETWEEN UNBOUNDED
        PRECEDING AND 1 PRECEDING) END AS gap, avg(calls) OVER (PARTITION BY user_id ORDER BY hour_index
        ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS past,
        count(*) OVER (PARTITION BY user_id ORDER BY hour_index
        ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS n_past,
        avg(calls) OVER (PARTITION BY user_id ORDER BY hour_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever FROM grid""",
    "medgap": "SELECT user_id, median(gap) AS med FROM gaps GROUP BY user_id",
    "feat": """SELECT user_id, hour_index, "timestamp", calls, active, s, split, in_fit, in_calib,
        is_true_threat, is_benign_burst, threat_class, episode_id, file_class,
        CASE WHEN active THEN greatest(0e0, least(1e1, calls / greatest(coalesce(
            CASE WHEN n_past >= 6 THEN past ELSE ever END, 1e0), 25e-2))) ELSE 0e0 END AS activity_rate,
        CASE WHEN active THEN CASE file_class WHEN 'public' THEN 0e0 WHEN 'internal' THEN 1e0 / 3e0
            WHEN 'confidential' THEN 2e0 / 3e0 ELSE 1e0 END ELSE 0e0 END AS file_type_category,
        CASE WHEN active THEN geo_index ELSE 0e0 END AS geo_index,
        CASE WHEN active THEN CASE endpoint_class WHEN 'read' THEN 0e0 WHEN 'write' THEN 25e-2
            WHEN 'share' THEN 5e-1 WHEN 'delete' THEN 75e-2 ELSE 1e0 END ELSE 0e0 END AS endpoint_operation,
        CASE WHEN active THEN permission_scope_delta ELSE 0e0 END AS permission_scope_delta,
        CASE WHEN active THEN collaboration_density ELSE 0e0 END AS collaboration_density,
        CASE WHEN active THEN coalesce(gap, med, 36e2) ELSE 0e0 END AS time_gap_sec
        FROM gaps JOIN medgap USING (user_id)""",
    "agap": """SELECT *, coalesce(sum(calls) OVER (PARTITION BY user_id ORDER BY hour_index RANGE BETWEEN 168 PRECEDING AND 1 PRECEDING), 0) AS past,
        (hour_index - lag(hour_index) OVER (PARTITION BY user_id ORDER BY hour_index)) * 36e2 AS gap FROM lab""",
    "afeat": """SELECT user_id, hour_index, in_fit, greatest(0e0, least(1e1, calls / greatest(CASE WHEN hour_index > 0
            THEN past / CAST(least(hour_index, 168) AS DOUBLE) ELSE 1e0 END, 25e-2))) AS activity_rate,
        CASE file_class WHEN 'public' THEN 0e0 WHEN 'internal' THEN 1e0 / 3e0 WHEN 'confidential' THEN 2e0 / 3e0 ELSE 1e0 END AS file_type_category,
        geo_index, CASE endpoint_class WHEN 'read' THEN 0e0 WHEN 'write' THEN 25e-2 WHEN 'share' THEN 5e-1 WHEN 'delete' THEN 75e-2
            ELSE 1e0 END AS endpoint_operation, permission_scope_delta, collaboration_density FROM agap""",
    "ascal": "SELECT " + ", ".join(f"avg({c}) AS mu_{i}, stddev_pop({c}) AS sd_{i}" for i, c in enumerate(fv.FEATURES))
             + " FROM afeat WHERE in_fit",
    "pstats": "SELECT user_id, " + ", ".join(
        f"avg(CASE WHEN in_fit{'' if i == 0 else ' AND active'} THEN {c} END) AS mu_{i}, "
        f"greatest(stddev_pop(CASE WHEN in_fit{'' if i == 0 else ' AND active'} THEN {c} END), 5e-2) AS sd_{i}"
        for i, c in enumerate(fv.FEATURES)) + " FROM feat GROUP BY user_id",
    "zfr": "SELECT feat.*, " + ", ".join(
        (f"greatest(-8e0, least(8e0, ({c} - mu_{i}) / sd_{i})) AS z_{i}" if i == 0 else
         f"CASE WHEN active THEN greatest(-8e0, least(8e0, ({c} - mu_{i}) / sd_{i})) ELSE 0e0 END AS z_{i}")
        for i, c in enumerate(fv.FEATURES)) + " FROM feat JOIN pstats USING (user_id)",
    "gscal": "SELECT " + ", ".join(f"avg({c}) AS mu_{i}, stddev_pop({c}) AS sd_{i}"
                                   for i, c in enumerate(fv.FEATURES)) + " FROM feat WHERE in_fit AND active",
    "prof": """SELECT c_custkey AS user_id, c_name AS user_name, c_mktsegment AS department, n_name AS home,
        CASE WHEN c_custkey % 2 = 0 THEN 'Google Drive' ELSE 'Microsoft OneDrive' END AS platform
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """`body` with the named expressions, and whatever they read, in front."""
    known, order = {**SQL, **(extra or {})}, []

    def visit(name):
        if name in order:
            return
        for dep in known:
            if dep != name and re.search(rf"(?<![\w.\"']){dep}(?![\w(])", known[name]):
                if re.search(rf"(FROM|JOIN|,|\))\s*\(?\s*{dep}\b", known[name]):
                    visit(dep)
        order.append(name)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body
