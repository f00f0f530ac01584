"""Model and streaming queries: memory bank, forest, encoder, training, serving, streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.operators import forest, frequent, scoring, sessions
from driftwarden.plans import event_scoring, session_training
from driftwarden.session import cut_lineage, shared_dir
from driftwarden.sources import tables
from driftwarden.streaming import audit, jobs
from driftwarden.streaming.ordered import keyed_state, ordered_ewma
from registry import Book, event_docs, fixtures as fx
from registry.behaviour import VEC_SQL
from registry.fixtures import r6

book = Book()
query = book.query

BANK_SQL = {**VEC_SQL,
    "wins": """SELECT user_id, hour_index, in_fit, flatten(w) AS f FROM (SELECT *, list(vec) OVER (PARTITION BY user_id ORDER BY hour_index
        ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS w FROM vecs) WHERE len(w) = 24 AND active""",
    "bank": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42|' || user_id || '|' || hour_index)) AS pick
        FROM wins WHERE in_fit) WHERE pick <= 256""",
    "cosines": """SELECT q.user_id, q.hour_index, list_cosine_similarity(q.f, b.f) AS cos FROM wins q LEFT JOIN bank b USING (user_id)"""}


@query("session_bank_scores", fx.sql("""SELECT user_id, hour_index, round(coalesce(1e0 - avg(cos), 0e0), 6) AS raw FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, hour_index ORDER BY cos DESC) AS rn FROM cosines) WHERE rn <= 10
    GROUP BY user_id, hour_index""", "cosines", extra=BANK_SQL))
def session_bank_scores(spark, sf_dir):
    f = active_features(spark, sf_dir)
    fit_hours = sessions.split_bounds(sessions.horizon(fx.hourly(spark, sf_dir)))["fit_end"]
    zrows = sessions.personal_frame(f, sessions.session_stats(f, fit_hours))
    return scoring.session_bank_scores(zrows).select("user_id", "hour_index", r6("raw", "raw"))


def demo_weights(hidden=16, seed=3):
    rng = np.random.default_rng(seed)
    return {"input": rng.normal(0, 0.3, (4 * hidden, 6)), "state": rng.normal(0, 0.3, (4 * hidden, hidden)),
            "bias": rng.normal(0, 0.1, 4 * hidden)}


@query("encoded_windows")
def encoded_windows(spark, sf_dir):
    """LSTM encoding of every scoreable window with a given weight table."""
    w = sessions.history_windows(fx.z_frame(spark, sf_dir)).filter("active").select("user_id", "hour_index", "window")
    out = scoring.encode_windows(w, "window", demo_weights())
    return out.select("user_id", "hour_index", F.transform("encoded", lambda x: fx.rd(x, 6)).alias("encoded"))


def active_features(spark, sf_dir):
    """Features of active sessions only; the dense grid is not built."""
    return fx.shared(spark, sf_dir, "active_features", lambda s, d: sessions.session_features(fx.labelled(s, d)))


def scaled(spark, sf_dir):
    f = active_features(spark, sf_dir)
    scaler = sessions.global_scaler(f)
    cols = ["user_id", "hour_index", *session_training.SCALED]
    return (sessions.global_frame(f, scaler, f.filter("in_fit")).select(*cols),
            sessions.global_frame(f, scaler, sessions.scoreable(f)).select(*cols))


@query("active_session_features", fx.sql("SELECT user_id, hour_index, round(time_gap_sec, 6) AS time_gap_sec, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in fv.FEATURES) + " FROM feat WHERE active", "feat"))
def active_session_features(spark, sf_dir):
    """The dense grid's features, computed without the grid."""
    f = sessions.session_features(fx.labelled(spark, sf_dir))
    return f.select("user_id", "hour_index", r6("time_gap_sec", "time_gap_sec"), *[r6(c, c) for c in fv.FEATURES])


@query("active_session_z", fx.sql("SELECT user_id, hour_index, " + ", ".join(f"round(z_{i}, 6) AS z_{i}" for i in range(6))
                                  + ", round((0 - mu_0) / sd_0, 6) AS idle_z FROM zfr JOIN pstats USING (user_id) WHERE active", "zfr", "pstats"))
def active_session_z(spark, sf_dir):
    f = active_features(spark, sf_dir)
    fit_hours = sessions.split_bounds(sessions.horizon(fx.hourly(spark, sf_dir)))["fit_end"]
    z = sessions.personal_frame(f, sessions.session_stats(f, fit_hours))
    return z.select("user_id", "hour_index", *[r6(f"z_{i}", f"z_{i}") for i in range(6)], r6("idle_z", "idle_z"))


@query("isolation_scores")
def isolation_scores(spark, sf_dir):
    fit, live = scaled(spark, sf_dir)
    grown = cut_lineage(forest.fit_forest(fit, session_training.SCALED, ["user_id", "hour_index"]))
    out = forest.forest_score(live, grown, session_training.SCALED)
    return out.select("user_id", "hour_index", r6("raw_if", "raw_if"))


def trained(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, fx.stamp(spark, sf_dir))
    if key not in _TRAINED:
        h = fx.hourly(spark, sf_dir)
        hours = sessions.horizon(h)
        _TRAINED[key] = session_training.train_and_score(sessions.assign_splits(h, hours), hours)
    return _TRAINED[key]


_TRAINED: dict = {}


@query("trained_session_scores")
def trained_session_scores(spark, sf_dir):
    """Features -> bank, forest and EWMA -> calibration -> tuning -> decisions."""
    out = trained(spark, sf_dir).scored
    return out.select("user_id", "hour_index", "split", *[r6(c, c) for c in ("a_lstm", "a_if", "a_hybrid", "sbrs_value")],
                      "ewma_flag", "hybrid_flag", "hybrid_action", "is_true_threat")


@query("event_scores")
def event_scores(spark, sf_dir):
    """Every event scored end to end with the trained model."""
    model = event_scoring.ServingModel(**trained(spark, sf_dir).tables)
    # model users are numeric ids; events carry formatted ids
    def named(df):
        return df.withColumn("user_id", F.format_string("USR%03d", "user_id"))
    model.user_stats, model.banks = named(model.user_stats), named(model.banks)
    events, sketched = frequent.stage_with_sketches(event_docs.documents(spark, sf_dir), "events", ["request.user_id"])
    out = event_scoring.score_events(events, model, event_docs.baselines(spark, sf_dir), sketched=sketched)
    return out.select("event.event_id", "pii.sensitivity_score", "anomaly.hybrid_anomaly_score", "anomaly.ewma_flagged",
                      "anomaly.hybrid_flagged", "sbrs.sbrs_value", "sbrs.enforcement_action")


@query("cached_replies", """SELECT doc_id, doc_id || '-vendor-model-1-' || substr(sha1(text), 1, 12) AS cache_key FROM documents
    WHERE doc_id % 7 <> 3""")
def cached_replies(spark, sf_dir):
    """Documents whose content- and model-addressed key holds a successful reply."""
    d = fx.table(spark, sf_dir, "documents")
    keys = tables.cache_keys(d.select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id", "vendor/model:1")
    cache = keys.select("cache_key", F.when(F.col("doc_id") % 7 == 3, "malformed_json").otherwise("ok").alias("status"))
    return tables.cache_hits(keys, cache).select("doc_id", "cache_key")


# --- streams --------------------------------------------------------------------------------
def stream(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def folder(spark, name):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}/{name}"


def run(df, spark, name):
    out = folder(spark, name)
    jobs.to_table(df, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


CLOSED = """SELECT * FROM (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS calls, round(sum(value), 2) AS x FROM events
    GROUP BY 1, 2) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


@query("streamed_hourly_counts", CLOSED)
def streamed_hourly_counts(spark, sf_dir):
    """Hours closed by the watermark, counted by a stream over the whole table."""
    events = jobs.event_time(stream(spark, sf_dir))
    out = run(jobs.hourly_counts(events, {"x": F.round(F.sum("value"), 2)}), spark, "hourly")
    return out.select("user_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "calls", "x")


@query("streamed_unique_events", "SELECT event_id, user_id, event_type, value FROM events")
def streamed_unique_events(spark, sf_dir):
    """Every event delivered twice, passed on once."""
    s = jobs.event_time(stream(spark, sf_dir))
    twice = s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return run(jobs.unique_events(twice).select("event_id", "user_id", "event_type", "value"), spark, "unique")


@query("streamed_ewma", fx.sql("SELECT user_id, \"timestamp\" AS hour, round(p, 6) AS ewma_previous, round(n, 6) AS ewma_new, "
                               "round(d, 6) AS ewma_deviation FROM ew JOIN lab USING (user_id, hour_index)", "ew", "lab"))
def streamed_ewma(spark, sf_dir):
    """Stateful EWMA over a stream of hourly sessions."""
    source = folder(spark, "sessions")
    hourly = fx.hourly(spark, sf_dir).select("user_id", F.col("timestamp").alias("hour"), "x")
    hourly.write.parquet(source)
    out = run(jobs.ewma_updates(spark.readStream.schema(hourly.schema).parquet(source), "x"), spark, "ewma")
    return out.select("user_id", F.col("hour").cast("timestamp_ntz").alias("hour"), r6("ewma_previous", "ewma_previous"),
                      r6("ewma_new", "ewma_new"), r6("ewma_deviation", "ewma_deviation"))


@query("streamed_ordered_ewma", fx.sql("SELECT user_id, \"timestamp\" AS hour, round(p, 6) AS ewma_previous, round(n, 6) AS ewma_new, "
                                       "round(d, 6) AS ewma_deviation FROM ew JOIN lab USING (user_id, hour_index)", "ew", "lab"))
def streamed_ordered_ewma(spark, sf_dir):
    """Hourly sessions in three deliveries without any order in time, held in state and folded in order; a mark a year ahead
    closes the last hours."""
    root = folder(spark, "ordered_ewma")
    hourly = fx.hourly(spark, sf_dir).select("user_id", F.col("timestamp").alias("hour"), "x")
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)      # of a delivery
    for i in range(3):
        delivery = hourly.filter(F.pmod(F.xxhash64("user_id", "hour"), F.lit(3)) == i)
        delivery.repartition(files, "user_id", "hour").write.mode("append").parquet(f"{root}/in")
    end = hourly.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("hour") + F.expr("INTERVAL 1 YEAR")).alias("hour"), F.lit(0.0).alias("x"))
    end.select(*[F.col(c).cast(t).alias(c) for c, t in hourly.dtypes]).write.mode("append").parquet(f"{root}/in")
    src = spark.readStream.schema(hourly.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    with keyed_state(spark):
        updates = ordered_ewma(src, "x", delay="200 days", idle_days=1000)
        jobs.to_table(updates, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    out = spark.read.schema(updates.schema).parquet(f"{root}/out")
    return out.select("user_id", F.col("hour").cast("timestamp_ntz").alias("hour"), r6("ewma_previous", "ewma_previous"),
                      r6("ewma_new", "ewma_new"), r6("ewma_deviation", "ewma_deviation"))


@query("streamed_hourly_ewma", fx.sql("""SELECT user_id, "timestamp" AS hour, round(p, 6) AS ewma_previous, round(n, 6) AS ewma_new,
    round(d, 6) AS ewma_deviation FROM ew JOIN lab USING (user_id, hour_index)
    WHERE "timestamp" + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""", "ew", "lab"))
def streamed_hourly_ewma(spark, sf_dir):
    """Events in four deliveries -> table of closed hours -> EWMA state, one micro-batch or more after each delivery."""
    root, e = folder(spark, "hourly_ewma"), fx.table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("ts").alias("lo")).scalar().cast("timestamp"), e.agg(F.max("ts").alias("hi")).scalar().cast("timestamp")
    share = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(lo)) / F.greatest(F.unix_micros(hi) - F.unix_micros(lo), F.lit(1))
    for i in range(4):
        e.filter(F.least(F.floor(share * 4), F.lit(3)) == i).write.mode("append").parquet(f"{root}/events")
        events = jobs.event_time(spark.readStream.schema(e.schema).parquet(f"{root}/events"))
        hours = jobs.hourly_counts(events, {"x": F.round(F.sum("value"), 2)}).select("user_id", "hour", "x")
        jobs.to_table(hours, f"{root}/hours", f"{root}/hours-checkpoint").awaitTermination()
        updates = jobs.ewma_updates(spark.readStream.schema(hours.schema).parquet(f"{root}/hours"), "x")
        jobs.to_table(updates, f"{root}/ewma", f"{root}/ewma-checkpoint").awaitTermination()
    out = spark.read.schema(updates.schema).parquet(f"{root}/ewma")
    return out.select("user_id", F.col("hour").cast("timestamp_ntz").alias("hour"), r6("ewma_previous", "ewma_previous"),
                      r6("ewma_new", "ewma_new"), r6("ewma_deviation", "ewma_deviation"))


def stream_scored(spark, sf_dir):
    base = fx.activity(spark, sf_dir).groupBy("user_id").agg(fx.rd(F.avg("value"), 2).alias("ewma_baseline"))
    return jobs.score_stream(stream(spark, sf_dir), base, F.least(F.lit(100.0), F.col("value")), F.col("value"))


SCORED_STREAM = """SELECT event_id, user_id, sbrs, CASE WHEN sbrs >= 184e-2 THEN 'BLOCK' WHEN sbrs >= 122e-2 THEN 'ALERT' ELSE 'PERMIT' END AS action FROM (
    SELECT event_id, user_id, least(1e2, value) * (1e0 + 25e-1 * greatest(0e0, least(1e0, (value - b) / greatest(b, 1e-6) / 8e0))) / 1e2 AS sbrs
    FROM events JOIN (SELECT user_id, round(avg(value), 2) AS b FROM events GROUP BY user_id) USING (user_id))"""


@query("streamed_scores", f"SELECT event_id, user_id, round(sbrs, 6) AS sbrs_value, action FROM ({SCORED_STREAM})")
def streamed_scores(spark, sf_dir):
    """Stream-static scoring against stored baselines."""
    out = stream_scored(spark, sf_dir).select("event_id", "user_id", r6("sbrs_value", "sbrs_value"), "action")
    return run(out, spark, "scores")


@query("streamed_enforcement", f"SELECT action, event_id FROM ({SCORED_STREAM}) WHERE action <> 'PERMIT'")
def streamed_enforcement(spark, sf_dir):
    """BLOCK audit and ALERT queue written by an idempotent batch sink; a second query over the same events adds nothing."""
    root = folder(spark, "enforcement")
    scored = stream_scored(spark, sf_dir).select("event_id", "user_id", "sbrs_value", "action")
    for run_of in ("first", "second"):
        jobs.enforce(scored, f"{root}/audit", f"{root}/queue", f"{root}/checkpoint-{run_of}").awaitTermination()
    parts = [spark.read.parquet(f"{root}/{p}").select("action", "event_id") for p in ("audit", "queue")]
    return parts[0].unionByName(parts[1])


@query("streamed_audit_tables", f"SELECT action, event_id FROM ({SCORED_STREAM}) WHERE action <> 'PERMIT'")
def streamed_audit_tables(spark, sf_dir):
    """The same through audit tables with commits: each stream is run twice, under two names, and the second adds nothing."""
    root = folder(spark, "audit")
    scored = stream_scored(spark, sf_dir).select("event_id", "user_id", "sbrs_value", "action")
    parts = []
    for action in ("BLOCK", "ALERT"):
        for name in ("first", "second"):
            audit.append_to_audit(scored.filter(F.col("action") == action), f"{root}/{action}", "event_id", name,
                                  f"{root}/checkpoint-{action}-{name}").awaitTermination()
        parts.append(audit.read_audit(spark, f"{root}/{action}", scored.schema).select("action", "event_id"))
    return parts[0].unionByName(parts[1])
