"""Hours in shuffled order through the state processor, against the batch scan."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import ewma
from driftwarden.streaming import jobs
from driftwarden.streaming.ordered import keyed_state, ordered_ewma

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "user_id bigint, hour timestamp, x double"


def drain(spark, batches, tmp_path, name="out", **how):
    """One micro-batch per list of rows; the last one only moves the watermark."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with keyed_state(spark):
        out = ordered_ewma(src, "x", **how)
        query = jobs.to_table(out, str(tmp_path / name), str(tmp_path / f"{name}-cp"))
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / name)), query.recentProgress


def at(hour):
    return T0 + dt.timedelta(hours=hour)


def test_three_shuffled_batches_equal_the_batch_scan(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(u, at(h), float(rnd.randrange(1, 90))) for u in range(4) for h in rnd.sample(range(60), 30)] + [(9, at(5), 3.0)]
    rnd.shuffle(rows)
    batches = [rows[i::3] for i in range(3)] + [[(-1, at(24 * 30), 1.0)]]
    out, progress = drain(spark, batches, tmp_path, delay="10 days", idle_days=3)
    got = {(r.user_id, r.hour): (r.ewma_previous, r.ewma_new, r.ewma_deviation) for r in out.collect()}
    flat = spark.createDataFrame(rows, SCHEMA).withColumn("hour_index", (F.unix_seconds("hour") / 3600).cast("bigint"))
    want = {(r.user_id, r.hour): (r.ewma_previous, r.ewma_new, r.ewma_deviation) for r in ewma.ewma_stream(flat, "x").collect()}
    assert got.keys() == want.keys() and len(got) == 121
    for k in want:
        assert got[k] == pytest.approx(want[k])
    # a user with waiting hours has state; when they are folded and the users idle, only the mark's own is left
    states = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda x: json.loads(x.json), progress) if p["stateOperators"]]
    assert max(states) >= 5 and states[-1] <= 2


def test_idle_users_begin_anew_and_late_hours_are_dropped(spark, tmp_path):
    batches = [[(1, at(1), 10.0), (1, at(0), 4.0)], [(2, at(100), 1.0)], [(2, at(90), 5.0)], [(1, at(2), 99.0), (1, at(300), 7.0)], [(2, at(900), 1.0)]]
    out, _ = drain(spark, batches, tmp_path, delay="20 hours", idle_days=2)
    got = sorted((r.user_id, r.x, r.ewma_previous, r.ewma_new) for r in out.collect())
    # hour 2 is behind the watermark (80) when it comes; hour 90 of user 2 is not, and goes before hour 100; user 1 is dropped at hour 49
    assert got == [(1, 4.0, 4.0, 4.0), (1, 7.0, 7.0, 7.0), (1, 10.0, 4.0, pytest.approx(5.8)),
                   (2, 1.0, 5.0, pytest.approx(3.8)), (2, 5.0, 5.0, 5.0)]
