import json

import pytest
from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.operators import enforcement, events as ev
from driftwarden.sources import layouts, tables

SCANS = [dict(zip([c for c, _ in fv.PII_SCAN_COLUMNS], r)) for r in [
    ("PII-0001", "2026-04-13 08:05:00", "USR004", "A B", "Legal", "Drive", "a.xlsx", "text_extractable", fv.BRANCH1, "N/A",
     "5", "20", "15", "100", "HIGH-RISK", "100", "HIGH-RISK", "87.3", "BLOCK", "True", "TRUE"),
    ("PII-0002", "not a time", "USR005", "C D", "HR", "Drive", "b.jpg", "scanned_pdf", fv.BRANCH3, "0.85",
     "x", "1", "", "5", "SAFE", "0", fv.BLIND_LABEL, "oops", "PERMIT", "maybe", "false")]]

EVENT = {"event_id": "EVT-1", "timestamp": "2026-04-13 08:05:00", "event_type": "upload",
         "request": {"user_id": "USR001", "user_name": "N", "department": "HR", "platform": "Drive", "file_name": "f.docx",
                     "file_type": "docx", "api_action": "UPLOAD", "geo_location": "Karachi, PK", "activity_rate_per_hour": 12.5},
         "pii_detection": {"ocr_confidence": "N/A", "high_count": 5, "medium_count": 20, "low_count": 15, "sensitivity_score": -1,
                           "entities_detected": [{"type": "NID", "count": 3, "sensitivity_tier": "HIGH", "weight": 10, "contribution": 30},
                                                 {"type": "PHONE", "count": 8, "sensitivity_tier": "medium"}]},
         "enforcement": {"action": "BLOCK", "reason": "policy"}}
BARE = {"event_id": "EVT-2"}
META = {"run_id": "r1", "users_monitored": 2, "total_events": 2, "saas_platforms": ["Drive"]}


def write_csv(path, rows):
    lines = [",".join(rows[0])] + [",".join(str(v) for v in r.values()) for r in rows]
    path.write_text("\n".join(lines), encoding="utf-8")


@pytest.fixture()
def root(tmp_path):
    write_csv(tmp_path / "pii_scan_results.csv", SCANS)
    write_csv(tmp_path / "blocked_events_audit.csv", [dict(zip([c for c, _ in fv.BLOCKED_AUDIT_COLUMNS], (
        "BLK-001", "2026-04-13 08:45:00", "USR001", "A", "Finance", "p.xlsx", "75", "0.82", "HIGH-RISK PII — cards", "Drive", "J-1", "60")))])
    write_csv(tmp_path / "ewma_user_baselines.csv", [dict(zip([c for c, _ in fv.BASELINE_COLUMNS], (
        "USR001", "A", "Finance", w, "0.3", "6.4", cur, "0.03", "2.0", "NORMAL", "2026-04-13 11:01:00")))
        for w, cur in (("1h", "0"), ("7d", "5.5"))])
    comparison = ("ANOM-0001", "2026-04-13 11:19:00", "USR008", "O", "Legal", "Drive", "a.pdf", "179", "20.112", "2.427", "7.7325", "7.2838",
                  "True", "0.0208", "0.1222", "0.0614", "False", "34", "0.3504", "SENSITIVE", "BLOCK", "ALERT", "False", "False", "True")
    write_csv(tmp_path / "anomaly_detection_comparison.csv", [dict(zip([c for c, _ in fv.COMPARISON_COLUMNS], comparison))])
    (tmp_path / "events.json").write_text(json.dumps({"log_metadata": META, "events": [EVENT, BARE]}), encoding="utf-8")
    (tmp_path / "system.log").write_text("line one\nline two\n")
    return str(tmp_path)


def test_tables_coerce_bad_values_to_null(spark, root):
    a, b = tables.load(spark, root, "pii_scans").orderBy("scan_id").collect()
    assert a.ocr_confidence is None and a.high_entities == 5 and a.slack_alert_sent is True and a.timestamp.hour == 8
    assert b.ocr_confidence == 0.85 and b.timestamp is None and b.high_entities is None and b.low_entities is None
    assert b.processing_ms is None and b.slack_alert_sent is None and b.jira_ticket_created is False
    assert "—" in tables.load(spark, root, "blocked_audit").first().reason
    c = tables.load(spark, root, "anomaly_comparison").first()
    assert c.time_gap_sec == 179.0 and c.pii_sensitivity_score == 34 and c.ewma_anomaly_flagged is True


def test_measured_file_is_preferred(spark, root, tmp_path):
    assert tables.resolve(spark, root, "pii_scans").endswith("pii_scan_results.csv")
    write_csv(tmp_path / "pii_scan_results_v2_real.csv", SCANS[:1])
    assert tables.load(spark, root, "pii_scans").count() == 1
    with pytest.raises(FileNotFoundError, match="nowhere"):
        tables.resolve(spark, root + "/nowhere", "events")


def test_load_all_registers_views_and_counts(spark, root):
    loaded = tables.load_all(spark, root)
    counts = {r.table: r.rows for r in loaded["row_counts"].collect()}
    assert counts["pii_scans"] == 2 and counts["events"] == 2 and counts["system_log"] == 2 and counts["ewma_baselines"] == 2
    assert spark.sql("select count(*) from pii_scans").first()[0] == 2
    assert ev.service_summary(loaded["log_metadata"]).first().run_id == "r1"
    for name in loaded:
        if name != "row_counts":
            spark.catalog.uncacheTable(name)


def test_events_document(spark, root, tmp_path):
    events, _ = tables.read_events_document(spark, f"{root}/events.json")
    cols = ev.pii_columns()
    rows = {r.event_id: r for r in events.select("event_id", *[c.alias(n) for n, c in cols.items()]).collect()}
    full, bare = rows["EVT-1"], rows["EVT-2"]
    assert full.sensitivity_score == 100 and full.risk_category == "HIGH-RISK" and full.branch == fv.BRANCH1 and full.ocr_confidence is None
    assert [(e.type, e.weight, e.contribution, e.sensitivity_tier) for e in full.entities_detected] == [("NID", 10, 30, "HIGH"), ("PHONE", 5, 40, "MEDIUM")]
    assert bare.sensitivity_score == 0 and bare.branch == fv.SERVING_BRANCH2 and bare.entities_detected == []
    check = ev.derivation_check(events).first()
    assert (check.verified, check.derived, check.mismatches) == (1, 1, 0)
    assert ev.get_event(events, "EVT-2").select(ev.event_summary().alias("s")).first().s.user_id == "?"
    with pytest.raises(KeyError):
        ev.get_event(events, "EVT-9")
    assert ev.list_events(events, "upload").count() == 1 and ev.list_events(events, limit=1).count() == 1
    assert ev.nearest_to_target(events).first().event_id == "EVT-2"
    (tmp_path / "broken.json").write_text(json.dumps({"events": []}))
    with pytest.raises(ValueError):
        tables.read_events_document(spark, str(tmp_path / "broken.json"))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(e) for e in (EVENT, BARE)))
    lines = tables.read_event_lines(spark, str(tmp_path / "lines.json"))
    assert lines.exceptAll(events).isEmpty() and lines.count() == 2
    payload = spark.createDataFrame([(json.dumps(EVENT),)], "payload string")
    assert tables.parse_payload(payload).first().request.file_name == "f.docx"


def test_baseline_priority_and_fallback(spark, root):
    b = tables.load(spark, root, "ewma_baselines").withColumn("position", F.monotonically_increasing_id())
    assert ev.baseline_of_users(b).first().ewma_baseline == 6.4          # 1h row wins, current 0 -> stored baseline
    assert ev.baseline_of_users(b.filter("time_window <> '1h'")).first().ewma_baseline == 5.5


def test_write_and_rewrite_keep_layout(spark, root):
    df = tables.load(spark, root, "anomaly_comparison")
    out = root + "/copy"
    tables.write_table(df, out, fv.COMPARISON_COLUMNS)
    assert tables.read_table(spark, out, fv.COMPARISON_COLUMNS).first() == df.first()
    new = tables.rewrite(spark, out, fv.COMPARISON_COLUMNS, lambda d: enforcement.refresh_risk(d))
    assert new != out
    row = tables.read_table(spark, new, fv.COMPARISON_COLUMNS).first()
    assert row.sbrs_value == pytest.approx(34 * (1 + 2.5 * 0.0614) / 100, abs=1e-4) and row.hybrid_action == "PERMIT"
    tables.write_table(df, root + "/pq", fv.COMPARISON_COLUMNS, delimited=False)
    assert spark.read.parquet(root + "/pq").columns == [c for c, _ in fv.COMPARISON_COLUMNS]


def test_sessions_and_ground_truth(spark, tmp_path):
    names = [c for c, _ in fv.SESSION_COLUMNS]
    row = {n: "" for n in names} | {"user_id": "U1", "timestamp": "2026-04-01 00:00:00", "hour_index": "0", "calls": "3", "active": "True",
                                    "threat_class": "NaN", "episode_id": "e1"}
    write_csv(tmp_path / "s.csv", [row])
    s = tables.read_sessions(spark, str(tmp_path / "s.csv")).first()
    assert s.threat_class is None and s.episode_id == "e1" and s.calls == 3 and s.active is True
    docs = {"documents": [{"doc_id": "D1", "category": "text_extractable", "text": "t", "entities": [{"type": "NID", "value": "1"}]},
                          {"doc_id": "D2", "category": "scanned", "entities": []}]}
    (tmp_path / "gt.json").write_text(json.dumps(docs))
    text, images = tables.read_ground_truth(spark, str(tmp_path / "gt.json"))
    assert text.first().entities[0].value == "1" and [r.doc_id for r in images.collect()] == ["D2"]


def metrics_document():
    doc = {}
    for i, path in enumerate(tables.METRIC_PATHS.values()):
        node = doc
        *parents, leaf = path.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = i
    return doc


def test_metrics_read_flat_or_nothing(spark, tmp_path):
    doc = metrics_document()
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    got = tables.read_metrics(spark, str(tmp_path / "m.json")).first().asDict()
    assert list(got.values()) == list(range(len(got)))
    del doc["latency"]
    (tmp_path / "partial.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{ not json")
    for name in ("partial.json", "bad.json", "missing.json"):
        assert tables.read_metrics(spark, str(tmp_path / name)).count() == 0
    pii = {"vlm": {"model": "m"}, "corpus": {"gold_entities": 3}, "baseline_text_only": {"overall_weighted_recall": .2},
           "latency_ms": {"branch1_mean": 1.0, "branch2_mean": 2.0},
           "results": {"paper_tau_0.85": {"tau": .85, "overall_micro": {"f1": .8}, "overall_weighted_recall": .9,
                       "by_category": {c: {"recall": .5} for c in fv.CATEGORIES}}}}
    (tmp_path / "p.json").write_text(json.dumps(pii))
    r = tables.read_metrics(spark, str(tmp_path / "p.json"), tables.PII_METRIC_PATHS).first()
    assert r.tau_ocr == .85 and r.handwritten_recall == .5 and r.gold_entities == 3


def test_metrics_sink(spark, tmp_path):
    a = spark.createDataFrame([("x", 1.0)], "name string, f1 double")
    tables.write_metrics({"flags": a, "empty": a.filter("f1 > 2")}, str(tmp_path / "out"))
    doc = spark.read.json(str(tmp_path / "out")).first()
    assert doc.flags[0].f1 == 1.0 and not doc.empty


def test_prediction_cache(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "D1.jpg").write_bytes(b"abc")
    (tmp_path / "files" / "D2.jpg").write_bytes(b"xyz")
    files = spark.read.format("binaryFile").load(str(tmp_path / "files")).withColumn("doc_id", F.regexp_extract("path", "(D\\d)\\.jpg", 1))
    keys = tables.cache_keys(files, "doc_id", "a/b:c")
    assert {r.cache_key for r in keys.collect()} >= {"D1-a-b-c-a9993e364706"}
    cache = keys.select("cache_key", F.when(F.col("doc_id") == "D1", "ok_empty").otherwise("malformed_json").alias("status"))
    assert [r.doc_id for r in tables.cache_hits(keys, cache).collect()] == ["D1"]


def test_stored_row_invariants(spark, root):
    rules = {"s": F.col("sensitivity_score") == F.least(F.lit(100), 10 * F.col("high_entities") + 5 * F.col("medium_entities") + F.col("low_entities"))}
    rows = tables.load(spark, root, "pii_scans")
    assert {r.rule: r.violations for r in enforcement.violations(rows, rules).collect()} == {"s": 1}
    assert layouts.EVENT.startswith("event_id string")
