"""Shape of physical plans: pruned and pushed scans, no pair-producing joins."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from driftwarden.operators import events as ev, reports, sessions
from driftwarden.sources import layouts
from registry import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["enforcement_by_action", "hourly_sessions", "session_features", "session_bank_scores", "memory_bank_scores",
                                  "fusion_grid", "document_scan", "exact_matches", "event_features", "score_auc", "scan_rows"])
def test_no_pair_joins(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_scans_read_only_what_they_need(spark, sf):
    text = plan(entry.queries()["document_scan"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "lang:string" not in text
    text = plan(entry.queries()["ewma_stream"](spark, sf))
    assert "ReadSchema: struct<k:bigint,b:bigint,first:double,g:double,d:double>" in text       # going up and down the blocks, no rows


def test_event_filter_and_nested_fields_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([], layouts.EVENT).write.parquet(str(tmp_path / "e"))
    events = spark.read.schema(layouts.EVENT).parquet(str(tmp_path / "e"))
    text = plan(ev.list_events(events, "upload", limit=None))
    assert "EqualTo(event_type,upload)" in text and "geo_location" not in text and "entities_detected" not in text


def test_report_is_one_pass(spark, sf):
    scored = fx.scored(spark, sf)
    text = plan(reports.detector_table(scored, {"a": F.col("ewma_flag"), "b": F.col("hybrid_flag")}))
    assert text.count("FileScan") == 1 and "Expand" not in text


def test_feature_windows_share_one_shuffle(spark, sf):
    text = plan(sessions.session_features(fx.labelled(spark, sf)))
    assert text.count("Exchange hashpartitioning(user_id") == 1
