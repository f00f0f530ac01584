import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.operators import events as ev, scoring
from driftwarden.plans import event_scoring
from driftwarden.sources import layouts, tables


@pytest.fixture(scope="module")
def model(spark):
    """Two known users; every personal mean 0 and deviation 1."""
    cols = ", ".join(f"mu_{i} double, sd_{i} double" for i in range(6))
    stats = spark.createDataFrame([(u, *[x for _ in range(6) for x in (0.0, 1.0)]) for u in ("USR001", "USR002")], f"user_id string, {cols}")
    scaler = spark.createDataFrame([tuple(x for _ in range(6) for x in (0.0, 1.0))], cols)
    banks = spark.createDataFrame([("USR001", i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(12)] + [("USR002", 0, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0])],
                                  "user_id string, hour_index bigint, tail array<double>")
    # one tree, split on activity_rate at 2: low -> depth 4, high -> depth 1
    forest = spark.createDataFrame([(0, 4, [0, -1, -1], [2.0, 0.0, 0.0], [1, 1, 2], [2, 1, 2], [0.0, 4.0, 1.0])],
                                   "tree int, sample_size int, feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>")
    cal = spark.createDataFrame([("bank", 0.0, 1.0), ("forest", 0.0, 1.0)], "name string, lo double, hi double")
    params = spark.createDataFrame([(0.25, 0.5, 2.5)], "alpha double, tau_hybrid double, tau_ewma double")
    return event_scoring.ServingModel(stats, scaler, banks, forest, cal, params)


@pytest.fixture(scope="module")
def events(spark):
    def e(i, user, rate, s, geo=None, high=0):
        req = (user, None, "HR", None, "f.docx", "docx", None, "VIEW", geo, rate)
        return (f"E{i}", None, None, None, req, (None, None, "N/A", high, 0, 0, s, None, None, None), None)
    return spark.createDataFrame([e(1, "USR001", 30.0, 80), e(2, "USR001", 10.0, -1, high=2), e(3, "ghost", None, None), e(4, None, 5.0, 100)],
                                 layouts.EVENT)


@pytest.fixture(scope="module")
def baselines(spark):
    return spark.createDataFrame([("USR001", "1h", 0, 10.0, 10.0)], "user_id string, time_window string, position int, baseline_ewma double, current_ewma double")


def test_scores(model, events, baselines):
    rows = {r.event.event_id: r for r in event_scoring.score_events(events, model, baselines).collect()}
    assert set(rows) == {"E1", "E2", "E3", "E4"}
    a = rows["E1"].anomaly
    # x = (3, 1, .5, 0, 0, 0): cosine with the activity axis is 3 / |x|
    cosine = 3 / (3 ** 2 + 1 + 0.25) ** 0.5
    assert a.feature_vector["activity_rate"] == 3.0 and a.lstm_score == pytest.approx(1 - cosine, abs=1e-4)
    assert a.ewma_score == pytest.approx(0.3 * 30 + 0.7 * 10) and a.ewma_flagged is False
    norm = 2 * (0.5772156649 + 1.0986122887) - 2 * 3 / 4
    assert a.isolation_forest_score == pytest.approx(2 ** (-1.0 / norm), abs=1e-4)
    fused = 0.25 * (1 - cosine) + 0.75 * 2 ** (-1.0 / norm)
    assert a.hybrid_anomaly_score == pytest.approx(fused, abs=1e-4) and a.hybrid_flagged == (fused >= 0.5)
    assert rows["E1"].sbrs.sbrs_value == pytest.approx(80 * (1 + 2.5 * a.hybrid_anomaly_score) / 100, abs=1e-4)
    assert rows["E2"].pii.sensitivity_score == 20                        # -1 means recompute
    ghost = rows["E3"]
    assert ghost.anomaly.ewma_score is None and ghost.anomaly.ewma_flagged is None
    assert ghost.anomaly.feature_vector["activity_rate"] == 1.0 and ghost.anomaly.feature_vector["file_type_category"] == 0.3333
    assert rows["E4"].event.user_id == "?" and rows["E4"].sbrs.enforcement_action in ("ALERT", "BLOCK")


def test_alpha_and_beta_override(model, events, baselines):
    one = events.filter("event_id = 'E1'")
    r = event_scoring.score_events(one, model, baselines, alpha=1.0, beta=0.0).first()
    assert r.anomaly.alpha == 1.0 and r.anomaly.hybrid_anomaly_score == r.anomaly.lstm_score and r.sbrs.sbrs_value == 0.8
    with pytest.raises(ValueError):
        event_scoring.score_events(one, model, baselines, alpha=2.0)


def test_unseen_users_take_global_bank(spark, model, events, baselines):
    stats, bank = event_scoring.fallback_context(model)
    assert stats.first().sd == [1.0] * 6 and len(bank.first().bank) == 13 <= fv.GLOBAL_BANK_CAP
    assert event_scoring.user_context(model, baselines, ev.home_of_users(events)).filter(F.col("user_id") == "USR002").first().bank == [[0, 0, 0, 1.0, 0, 0]]


def coded(spark, model, codes, weights=None):
    table = spark.createDataFrame(codes, "user_id string, hour_index bigint, code array<double>")
    return event_scoring.ServingModel(model.user_stats, model.scaler, model.banks, model.forest, model.calibrators, model.params,
                                      table, scoring.weight_table(spark, weights) if weights else None)


def past(spark, rows):
    return spark.createDataFrame(rows, "event_id string, hours_before int, " + ", ".join(f"{c} double" for c in fv.SERVING_FEATURES))


def window_code(steps):
    """Flattened unit window with the given vectors at the hours before its end."""
    out = np.zeros((fv.SEQ_LEN, 6))
    for before, x in steps.items():
        out[-1 - before] = x
    return (out / np.linalg.norm(out)).reshape(-1).tolist()


def test_history_fills_the_window(spark, model, events, baselines):
    now, before = [3.0, 1.0, 0.5, 0.0, 0.0, 0.0], [2.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    banked = coded(spark, model, [("USR001", 30, window_code({0: now, 2: before}))])
    history = past(spark, [("E1", 2, *before), ("E1", 24, *[9.0] * 6), ("E1", 0, *[9.0] * 6), ("E1", None, *[9.0] * 6), (None, 1, *[9.0] * 6), ("E1", 2, *before)])
    rows = {r.event.event_id: r.anomaly for r in event_scoring.score_events(events, banked, baselines, history=history).collect()}
    assert set(rows) == {"E1", "E2", "E3", "E4"}
    assert rows["E1"].lstm_score == pytest.approx(0.0, abs=1e-4)             # the very window of the bank
    plain = event_scoring.score_events(events, banked, baselines, history=history.limit(0)).filter("event.event_id = 'E1'").first().anomaly
    cosine = np.dot(window_code({0: now}), window_code({0: now, 2: before}))
    assert plain.lstm_score == pytest.approx(1 - cosine, abs=1e-4)
    with pytest.raises(ValueError):
        event_scoring.score_events(events, model, baselines, history=history)


def test_flattened_windows_agree_with_their_last_hour(spark, model, events, baselines):
    """Without history the encoded banks give what their last hours give."""
    code = window_code({0: [1.0, 2.0, 0.0, 0.0, 1.0, 0.0], 5: [0.5, 0.0, 1.0, 0.0, 0.0, 0.0]})
    banked = coded(spark, model, [("USR001", 30, code)])
    tails = event_scoring.ServingModel(model.user_stats, model.scaler, spark.createDataFrame(
        [("USR001", 30, code[-6:])], "user_id string, hour_index bigint, tail array<double>"), model.forest, model.calibrators, model.params)
    by_code = event_scoring.score_events(events, banked, baselines, history=past(spark, []))
    by_tail = event_scoring.score_events(events, tails, baselines)
    key = "event.event_id"
    got, want = ([r.anomaly.lstm_score for r in df.orderBy(key).collect()] for df in (by_code, by_tail))
    assert got == pytest.approx(want, abs=1e-4)


def test_encoder_is_stored_and_used(spark, model, events, baselines, tmp_path):
    rng = np.random.default_rng(5)
    weights = {"input": rng.normal(0, 1, (8, 6)), "state": rng.normal(0, 1, (8, 2)), "bias": rng.normal(0, 1, 8)}
    window = np.zeros((1, fv.SEQ_LEN, 6))
    window[0, -1] = [3.0, 1.0, 0.5, 0.0, 0.0, 0.0]
    h = scoring._encode(window, weights)[0]
    banked = coded(spark, model, [("USR001", 30, h.tolist()), ("USR001", 31, (-h).tolist())], weights)
    tables.save_model({f.name: getattr(banked, f.name) for f in dataclasses.fields(banked)}, str(tmp_path))
    loaded = event_scoring.ServingModel(**tables.load_model(spark, str(tmp_path)))
    a = event_scoring.score_events(events, loaded, baselines).filter("event.event_id = 'E1'").first().anomaly
    assert a.lstm_score == pytest.approx(1.0, abs=1e-4)                       # the mean cosine with h and -h is 0


def test_users_without_codes_score_zero(spark, model, events, baselines):
    banked = coded(spark, model, [("USR002", 30, window_code({0: [1.0] * 6}))])
    rows = {r.event.event_id: r.anomaly.lstm_score for r in event_scoring.score_events(events, banked, baselines, history=past(spark, [])).collect()}
    assert rows["E1"] == 0.0 and rows["E3"] > 0.0                            # known without a bank; unknown: everyone's bank
    empty = coded(spark, model, [])
    assert {r.anomaly.lstm_score for r in event_scoring.score_events(events, empty, baselines, history=past(spark, [])).collect()} == {0.0}


def test_banks_are_the_windows_that_sessions_meet(spark):
    z = [f"z_{i}" for i in range(6)]
    rows = [("a", h, h % 3 > 0, 0.25, *[float((h * (i + 2)) % 5 - 2) for i in range(6)]) for h in range(0, 60, 2)] + [("b", 3, True, 0.0, *[1.0] * 6)]
    frame = spark.createDataFrame(rows, "user_id string, hour_index bigint, in_fit boolean, idle_z double, " + ", ".join(f"{c} double" for c in z))
    codes = scoring.bank_codes(frame, cap=5)
    got = codes.collect()
    assert len(got) == 5 and all(np.linalg.norm(r.code) == pytest.approx(1.0) and r.hour_index % 3 > 0 and r.hour_index >= 23 for r in got)
    every = scoring.bank_codes(frame.withColumn("in_fit", F.lit(True)), cap=1000)
    again = {(r._of, r.hour_index): r.raw for r in scoring.memory_bank_scores(
        every.select(F.col("user_id").alias("_of"), "hour_index", "code"), codes.select(F.col("user_id").alias("_of"), "code"), "_of", "code", ["hour_index"]).collect()}
    want = {(r.user_id, r.hour_index): r.raw for r in scoring.session_bank_scores(frame, cap=5).collect()}
    assert again == pytest.approx(want)


def test_deliveries_have_many_files(spark, sf):
    """Three deliveries, each dealt over files, so that no task writes or reads a whole one."""
    import glob

    from driftwarden.session import shared_dir
    from registry import serving

    pattern = shared_dir(spark).removeprefix("file:") + "/stream-*/events"
    before = set(glob.glob(pattern))
    assert serving.streamed_event_scores(spark, sf).count() == 1000
    (made,) = set(glob.glob(pattern)) - before
    files = glob.glob(f"{made}/*.parquet")
    assert 3 < len(files) <= 6 and len(glob.glob(f"{made}/../checkpoint/commits/[0-9]*")) == 3


def test_windows_take_the_largest_of_an_hour_and_zero_for_what_is_missing(spark):
    """In one pass of numpy: a window's hours are neither aggregated twice nor placed by an expression per hour and feature."""
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([("E1", [0.0] * 5 + [1.0], [0.5] * 5 + [None], [0.1] * 6), ("E2", [1.0] * 6, [2.0] * 6, [0.2] * 6), (None, [0.0] * 6, [1.0] * 6, [0.3] * 6)],
                                 "event_id string, _mu array<double>, _sd array<double>, _z array<double>")
    history = past(spark, [("E1", 1, 1.0, None, nan, 9.0, -9.0, 2.0), ("E1", 1, 0.5, 8.0, 8.0, 8.0, 8.0, 8.0), ("E1", 23, None, *[0.0] * 5), ("E1", 24, *[1.0] * 6),
                           ("E2", 3, *[inf] * 6), ("E2", None, *[1.0] * 6), (None, 2, *[1.0] * 6)])
    made = event_scoring._windows(rows, history)
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    got = {r.event_id: np.array(r._window) for r in made.collect()}
    want = {n: np.zeros((24, 6)) for n in ("E1", "E2", None)}
    want["E1"][22] = [2.0, 0.0, 8.0, 8.0, -8.0, 0.0]
    want["E2"][20] = 8.0
    for n, z in (("E1", 0.1), ("E2", 0.2), (None, 0.3)):
        want[n][23] = z
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in want)
