"""Quantile sketches, the partitioned store, VARIANT payloads, SQL functions and observed metrics."""

import json
import os
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.functions import scores, sql
from driftwarden.operators import enforcement, sketches
from driftwarden.session import stage_observed
from driftwarden.sources import layouts, payloads, store, tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sketches_of_hours_merge_into_any_range(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 120_000, p=[.9, .1]), "hour": rng.integers(0, 48, 120_000), "v": rng.gamma(2, 30, 120_000)})
    pdf.loc[::1000, "v"] = np.nan
    parts = sketches.sketched(spark.createDataFrame(pdf).repartition(6), ["v"], ["g", "hour"], 400).cache()
    assert parts.count() == 96
    some = sketches.merged(parts.filter("hour between 10 and 30"), ["v"], ["g"], 400)
    probs = {"p1": .01, "p50": .5, "p99": .99}
    for r in sketches.report(some, "v", probs, ["g"]).collect():
        x = np.sort(pdf[(pdf.g == r.g) & pdf.hour.between(10, 30)].v.dropna().to_numpy())
        assert r.n == len(x) and r["mean"] == pytest.approx(x.mean()) and (r["min"], r["max"]) == (x[0], x[-1])
        for name, p in probs.items():
            assert abs(np.searchsorted(x, r[name], side="right") / len(x) - p) < 0.012
    assert sketches.report(sketches.merged(parts, ["v"], size=400), "v", probs).first().n == pdf.v.notna().sum()


def test_small_groups_are_exact_and_empty_ones_null(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", None), ("b", float("nan"))], "g string, v double")
    got = {r.g: r for r in sketches.report(sketches.sketched(df, ["v"], ["g"]), "v", {"q1": .25, "p50": .5, "p76": .76, "max_": 1.0}, ["g"]).collect()}
    assert (got["a"].q1, got["a"].p50, got["a"].p76, got["a"].max_) == (1.0, 2.0, 3.0, 3.0)
    assert got["b"].n == 0 and got["b"].p50 is None and got["b"]["mean"] is None


def files(path):
    return {os.path.join(d, p): os.stat(os.path.join(d, p)).st_mtime_ns for d, _, names in os.walk(path) for p in names if p.endswith(".parquet")}


def test_refresh_rewrites_changed_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, ["train", "val", "test", None][i % 4], float(i), None if i % 5 == 0 else "x") for i in range(400)]
    store.create(spark.createDataFrame(rows, "id int, split string, v double, note string"), path, ["split"])
    before = files(path)

    def one_part(df):
        return df.withColumn("v", F.when(F.col("split") == "val", F.col("v") * 2).otherwise(F.col("v"))).withColumn(
            "note", F.when(F.col("split").isNull() & (F.col("id") == 3), "changed").otherwise(F.col("note")))

    report = {r.split: (r.rows, r.changed) for r in store.refresh(spark, path, ["split"], one_part).collect()}
    assert report == {"train": (100, 0), "val": (100, 100), "test": (100, 0), None: (100, 1)}
    after = files(path)
    kept = {n: t for n, t in after.items() if before.get(n) == t}
    assert len(kept) == 2 and len(after) == 4                 # train and test: same files, same times
    got = {r.id: (r.split, r.v, r.note) for r in spark.read.parquet(path).collect()}
    want = {i: (s, v * 2 if s == "val" else v, "changed" if i == 3 else n) for i, s, v, n in rows}
    assert got == want
    store.refresh(spark, path, ["split"], lambda df: df)       # nothing changes: nothing is written
    assert files(path) == after


def test_payloads_keep_unknown_fields_and_survive_wrong_types(spark):
    rows = [json.dumps({"event_id": "a", "request": {"user_id": 7, "activity_rate_per_hour": "12.5", "new": 1}, "extra": {"x": [1]},
                        "pii_detection": {"high_count": "many", "low_count": 3, "entities_detected": [{"type": "NID", "count": 2}, 5, None]}}),
            json.dumps({"event_id": ["no"], "request": "text", "zone": None}), "no json", None, "[]"]
    df = spark.createDataFrame([(r,) for r in rows], "payload string")
    events = payloads.events_of(payloads.parsed(df))
    assert events.drop("payload").schema.simpleString() == spark.createDataFrame([], layouts.EVENT).schema.simpleString()
    got = events.select("*", payloads.unknown_fields(F.col("payload")).alias("unknown"), payloads.field(F.col("payload"), "$.extra.x[0]", "int", -1).alias("x")).collect()
    a, b = got[0], got[1]
    assert a.event_id == "a" and a.request.user_id == "7" and a.request.activity_rate_per_hour == 12.5 and a.unknown == ["extra"] and a.x == 1
    assert a.pii_detection.high_count is None and a.pii_detection.low_count == 3
    assert [(e.type, e["count"]) for e in a.pii_detection.entities_detected] == [("NID", 2), (None, None), (None, None)]
    assert b.event_id is None or b.event_id == '["no"]'
    assert b.request is None and b.unknown == ["zone"] and b.x == -1
    assert all(r.event_id is None and r.request is None for r in got[2:])


def test_sql_functions_equal_columns(spark):
    assert len(sql.register(spark)) == len(sql.definitions())
    df = spark.createDataFrame([(i % 12, i % 9, i * 3 % 50, i * 1.7 - 9, (i % 11) / 7.0, i % 4, i % 7) for i in range(200)] + [(None,) * 7],
                               "h long, m long, l long, s double, a double, k long, n long")
    lo, hi = scores.wilson_bounds("k", "n")
    pairs = {"sensitivity_score(h, m, l)": scores.sensitivity("h", "m", "l"), "risk_value(s, a)": scores.sbrs("s", "a"),
             "risk_value(s, a, 1.5D)": scores.sbrs("s", "a", 1.5), "risk_category(s)": scores.band_category("s"), "risk_action(s)": scores.band_action("s"),
             "wilson_low(k, n)": lo, "wilson_high(k, n)": hi, "ewma_step(s, a)": scores.ewma_step("s", "a"),
             "ewma_deviation(s, a)": scores.ewma_deviation("s", "a"), "activity_ratio(s, a)": scores.activity_ratio("s", "a"),
             "half_even(s, 1)": scores.round_even("s", 1), "category_action(sensitivity_category(s))": scores.action_for(scores.risk_category("s"))}
    columns = [x for i, (text, column) in enumerate(pairs.items()) for x in (F.expr(text).alias(f"t{i}"), column.alias(f"c{i}"))]
    for row in df.select(*columns).collect():
        for i, text in enumerate(pairs):
            t, c = row[f"t{i}"], row[f"c{i}"]
            assert t == c or (t is not None and c is not None and (t == pytest.approx(c, rel=1e-12, abs=1e-12) or (t != t and c != c))), (text, row)
    found = spark.sql("SELECT i.low FROM {d} d, LATERAL wilson_interval(d.k, d.n) i WHERE d.n > 0", d=df)
    assert found.count() == df.filter("n > 0").count()


def test_observed_counts_and_rules(spark):
    df = spark.range(1000).withColumn("ok", F.when(F.col("id") % 10 != 0, F.col("id") % 3 == 0))
    staged, seen = stage_observed(df, "t", {"rows": F.count(F.lit(1)), "most": F.max("id")})
    assert staged.count() == seen["rows"] == 1000 and seen["most"] == 999
    rules = {"positive": F.col("id") >= 0, "known": F.col("ok").isNotNull(), "third": F.col("ok")}
    staged, broken = enforcement.stage_checked(df, "t", rules)
    assert sorted(map(tuple, broken.collect())) == sorted(map(tuple, enforcement.violations(df, rules).collect()))


JOBS = """
import glob, json, sys
sys.path.insert(0, {root!r})
from driftwarden.session import build_session
spark = build_session("jobs", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.eventLog.enabled": "true",
    "spark.eventLog.dir": {log!r}, "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}})
import __spark_entry__ as entry
for name in {names!r}:
    spark.sparkContext.setLocalProperty("query", name)
    entry.queries()[name](spark, {sf!r}).write.format("noop").mode("overwrite").save()
spark.stop()
"""


def test_events_are_read_three_times_at_most(sf, tmp_path):
    """By the event log: rows read from the events table for one column, and for all features of an event."""
    events = len(pd.read_parquet(f"{sf}/events.parquet", columns=["event_id"]))
    (tmp_path / "log").mkdir()
    names = ["event_ids", "event_features"]
    subprocess.run([sys.executable, "-c", JOBS.format(root=ROOT, log=str(tmp_path / "log"), names=names, sf=sf)], check=True, cwd=tmp_path,
                   stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, timeout=300)
    query_of, read, scans = {}, defaultdict(int), defaultdict(list)
    for line in open(next((tmp_path / "log").iterdir())):
        event = json.loads(line)
        if event["Event"] == "SparkListenerJobStart":
            for stage in event["Stage Infos"]:
                query_of[stage["Stage ID"]] = event["Properties"].get("query")
        elif event["Event"] == "SparkListenerTaskEnd":
            rows = event["Task Metrics"]["Input Metrics"]["Records Read"]
            scans[query_of.get(event["Stage ID"])].append(rows)
            read[query_of.get(event["Stage ID"])] += rows
    assert read["event_ids"] == events
    assert sum(r for r in scans["event_features"] if r == events) <= 3 * events      # whole-table scans of the events
    assert read["event_features"] < 5 * events


def test_load_all_counts_come_from_the_writing_jobs(spark, tmp_path):
    """One job per table: none for a count of its own."""
    for key in ("pii_scans", "anomaly_comparison", "ewma_baselines", "blocked_audit"):
        layout = tables.LAYOUTS[key]
        spark.createDataFrame([("1",) * len(layout)] * 3, ", ".join(f"`{c}` string" for c, _ in layout)).write.option("header", True).csv(
            str(tmp_path / tables.FILES[key][-1]))
    (tmp_path / "events.json").write_text('{"log_metadata": {"run_id": "r"}, "events": [{"event_id": "e"}]}')
    (tmp_path / "system.log").write_text("a\nb\n")
    context = spark.sparkContext
    context.setJobGroup("load", "load")
    loaded = tables.load_all(spark, str(tmp_path))
    jobs = len(context.statusTracker().getJobIdsForGroup("load"))
    context.setJobGroup("other", "other")
    assert {r["table"]: r["rows"] for r in loaded["row_counts"].collect()} == {
        "pii_scans": 3, "anomaly_comparison": 3, "ewma_baselines": 3, "blocked_audit": 3, "events": 1, "log_metadata": 1, "system_log": 2}
    assert jobs == 8                                          # seven tables, and the document's ranges
    assert spark.table("events").first().event_id == "e" and fv.METRIC_PATHS is tables.METRIC_PATHS
