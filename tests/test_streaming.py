import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import ewma
from driftwarden.streaming import jobs

T0 = dt.datetime(2026, 1, 1)


def write_batches(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, tmp_path, name):
    spark = df.sparkSession
    jobs.to_table(df, str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def test_stream_ewma_equals_batch_across_batches(spark, tmp_path):
    schema = "user_id bigint, hour timestamp, x double"
    batches = [[(u, T0 + dt.timedelta(hours=b * 10 + h), float((u + 1) * (b * 7 + h * 3 % 5 + 1))) for u in range(3) for h in (4, 1, 7)]
               for b in range(3)]
    src = write_batches(spark, str(tmp_path / "in"), batches, schema)
    got = {(r.user_id, r.hour): (r.ewma_previous, r.ewma_new, r.ewma_deviation) for r in drain(jobs.ewma_updates(src, "x"), tmp_path, "out").collect()}
    flat = spark.createDataFrame([r for b in batches for r in b], schema).withColumn(
        "hour_index", (F.unix_seconds("hour") / 3600).cast("bigint"))
    want = {(r.user_id, r.hour): (r.ewma_previous, r.ewma_new, r.ewma_deviation) for r in ewma.ewma_stream(flat, "x").collect()}
    assert set(got) == set(want) and len(got) == 27
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_hourly_counts_drop_late_rows_and_duplicates(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, user_id bigint"
    def at(minutes):
        return T0 + dt.timedelta(minutes=minutes)
    batches = [[(1, at(5), 7), (1, at(5), 7), (2, at(50), 7)], [(3, at(400), 7)], [(5, at(410), 7)],
               [(4, at(10), 7)], [(6, at(900), 7)]]          # event 4 arrives after its hour was closed
    src = jobs.event_time(write_batches(spark, str(tmp_path / "in"), batches, schema))
    rows = drain(jobs.hourly_counts(jobs.unique_events(src)), tmp_path, "out").collect()
    assert {(r.hour, r.calls) for r in rows} == {(T0, 2), (T0 + dt.timedelta(hours=6), 2)}


def test_enforcement_sink_is_idempotent(spark, tmp_path):
    schema = "event_id bigint, user_id bigint, s double, rate double"
    src = write_batches(spark, str(tmp_path / "in"), [[(1, 1, 100.0, 90.0), (2, 1, 60.0, 50.0), (3, 2, 5.0, 1.0)], [(4, 9, 100.0, 1.0)]], schema)
    base = spark.createDataFrame([(1, 10.0), (2, 1.0)], "user_id bigint, ewma_baseline double")
    scored = jobs.score_stream(src, base, F.col("s"), F.col("rate"))
    audit, queue = str(tmp_path / "audit"), str(tmp_path / "queue")
    for cp in ("cp1", "cp2"):                       # a full replay adds nothing
        jobs.enforce(scored, audit, queue, str(tmp_path / cp)).awaitTermination()
    assert [r.event_id for r in spark.read.parquet(audit).collect()] == [1]
    assert [r.event_id for r in spark.read.parquet(queue).collect()] == [2]


def test_enforcement_under_a_new_checkpoint_keeps_the_old_audit(spark, tmp_path):
    schema = "event_id bigint, user_id bigint, s double, rate double"
    base = spark.createDataFrame([(1, 10.0)], "user_id bigint, ewma_baseline double")
    audit, queue = str(tmp_path / "audit"), str(tmp_path / "queue")
    for run, ids in (("a", (1, 2)), ("b", (3, 2))):          # both queries number their batches from 0
        src = write_batches(spark, str(tmp_path / run), [[(i, 1, 100.0, 90.0)] for i in ids], schema)
        scored = jobs.score_stream(src, base, F.col("s"), F.col("rate"))
        jobs.enforce(scored, audit, queue, str(tmp_path / f"cp-{run}")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(audit).collect()) == [1, 2, 3]


def test_late_hours_leave_the_ewma_alone(spark, tmp_path):
    schema = "user_id bigint, hour timestamp, x double"
    def row(hour, x):
        return (1, T0 + dt.timedelta(hours=hour), x)
    src = write_batches(spark, str(tmp_path / "in"), [[row(1, 4.0), row(2, 6.0)], [row(0, 900.0), row(2, 800.0)], [row(3, 5.0)]], schema)
    got = {(r.hour, r.x): r for r in drain(jobs.ewma_updates(src, "x"), tmp_path, "out").collect()}
    assert len(got) == 5
    late = [r for r in got.values() if r.x >= 800]
    assert all(r.ewma_previous is None and r.ewma_new is None and r.ewma_deviation is None for r in late)
    second, third = got[(T0 + dt.timedelta(hours=2), 6.0)], got[(T0 + dt.timedelta(hours=3), 5.0)]
    assert third.ewma_previous == pytest.approx(second.ewma_new)


def test_events_to_hours_to_ewma_over_batches(spark, tmp_path):
    """Events -> hours closed by the watermark, a table -> stateful EWMA; equal to the batch scan of the closed hours."""
    schema = "event_id bigint, ts timestamp, user_id bigint"
    batches = [[(b * 40 + i, T0 + dt.timedelta(minutes=b * 150 + i * (3 + b)), i % 3) for i in range(40)] for b in range(4)]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = jobs.event_time(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        hours = jobs.hourly_counts(src).select("user_id", "hour", F.col("calls").cast("double").alias("x"))
        drain(hours, tmp_path, "hours")
        closed = spark.readStream.schema(hours.schema).parquet(str(tmp_path / "hours"))
        out = drain(jobs.ewma_updates(closed, "x"), tmp_path, "out")
    got = {(r.user_id, r.hour): r.ewma_new for r in out.collect()}
    last = max(ts for b in batches for _, ts, _ in b)
    counts = spark.createDataFrame([r for b in batches for r in b], schema).groupBy(
        "user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").cast("double").alias("x"))
    flat = counts.withColumn("hour_index", (F.unix_seconds("hour") / 3600).cast("bigint"))
    want = {(r.user_id, r.hour): r.ewma_new for r in ewma.ewma_stream(flat, "x").collect()
            if r.hour + dt.timedelta(hours=2) <= last}
    assert got.keys() == want.keys() and len(got) > 12
    for k in want:
        assert got[k] == pytest.approx(want[k])
