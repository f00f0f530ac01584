"""Large JSON documents read by ranges, against a parse of the whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from driftwarden.sources import json_parts as jp, layouts, tables

TRICKY = ['plain', 'quote " and \\ slash', 'ends in slashes \\\\', '\\"', '{[ not nested ]}', 'é ñ 漢字 \U0001f600', 'line\nbreak\ttab', '":', '{"events": [{}]}', '']


def document(n, seed=0, **dump):
    rnd = random.Random(seed)

    def event(i):
        return {"event_id": f"E{i}", "timestamp": rnd.choice(TRICKY), "module": rnd.choice(TRICKY),
                "request": {"user_id": rnd.choice(TRICKY), "file_name": "x" * rnd.choice([0, 5, 400]), "activity_rate_per_hour": i / 3},
                "pii_detection": rnd.choice([None, {"high_count": i, "entities_detected": [{"type": rnd.choice(TRICKY), "count": 1}, {}]}]), "other": [[{"a": 1}]]}
    doc = {"first": [{"event_id": "no"}], "log_metadata": {"run_id": "r\"1", "total_events": n, "saas_platforms": ["{", "a"]}, "events": [event(i) for i in range(n)],
           "behind": {"events": [{"event_id": "neither"}]}}
    return json.dumps(doc, **dump)


def whole(spark, path):
    doc = spark.read.schema(layouts.EVENTS_DOCUMENT).option("multiLine", True).json(path)
    return doc.select(F.inline("events")), doc.select("log_metadata.*")


@pytest.mark.parametrize("dump", [{}, {"indent": 2, "ensure_ascii": False}, {"separators": (",", ":")}])
def test_ranges_equal_one_parse(spark, tmp_path, dump):
    path = str(tmp_path / "d.json")
    open(path, "w", encoding="utf-8").write(document(40, 1, **dump))
    events, metadata = whole(spark, path)
    want = sorted(map(str, events.collect()))
    for size in (1 << 20, 997, 64):
        got, meta = tables.read_events_document(spark, path, size)
        assert sorted(map(str, got.collect())) == want and len(want) == 40
        assert meta.collect() == metadata.collect()
    assert tables.read_events_document(spark, path, 997)[0].rdd.getNumPartitions() > 10          # one document, many tasks


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_states_compose(size):
    """The composed state of every range equals the one that a walk over all bytes finds."""
    text = document(3, 2).encode()
    state, depth = jp.OUTSIDE, 0
    walk = []
    for byte in text:
        walk.append((state, depth))
        if state == jp.ESCAPED:
            state = jp.IN_STRING
        elif state == jp.IN_STRING:
            state = jp.ESCAPED if byte == jp.BACKSLASH else jp.OUTSIDE if byte == jp.QUOTE else jp.IN_STRING
        elif byte == jp.QUOTE:
            state = jp.IN_STRING
        else:
            depth += int(jp.STEP[byte])
    assert (state, depth) == (jp.OUTSIDE, 0)
    state, depth = jp.OUTSIDE, 0
    for at in range(0, len(text), size):
        assert (state, depth) == walk[at]
        data = text[at:at + size + 100]
        does = jp.summary(data, min(size, len(text) - at))[state]
        state, depth = does["end"], depth + does["change"]
    assert (state, depth) == (jp.OUTSIDE, 0)


@pytest.mark.parametrize("broken", ['{"log_metadata": {}, "events": [{"event_id": "a"}', '{"log_metadata": {}, "events": [{"event_id": "a]}', '{"log_metadata": {}, "events": []}}',
                                    '[1, 2]', '', '{"events": [{"event_id": "a"}]}', 'no json'])
def test_broken_documents_are_refused(spark, tmp_path, broken):
    (tmp_path / "b.json").write_text(broken)
    with pytest.raises(ValueError):
        tables.read_events_document(spark, str(tmp_path / "b.json"), 8)


def test_broken_objects_and_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"log_metadata": {"run_id": "x"}, "events": [{"event_id": "a"}, {"event_id": }, {"event_id": "b"}, 7, null, []]}')
    (tmp_path / "b.json").write_text('{"events": [{"event_id": "c"}, {"event_id"')
    (tmp_path / "c.json").write_text('{"log_metadata": {"run_id": "y"}, "events": []}')
    (tmp_path / "_SUCCESS").write_text("")
    events, metadata = tables.read_events_document(spark, str(tmp_path), 16)
    assert sorted(r.event_id for r in events.collect()) == ["a", "b"] and sorted(r.run_id for r in metadata.collect()) == ["x", "y"]


def test_small_documents_share_a_task(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i:02}.json").write_text(json.dumps({"log_metadata": {"run_id": f"r{i}"}, "events": [{"event_id": f"e{i}"}, {"event_id": f"f{i}"}]}))
    events, metadata = tables.read_events_document(spark, str(tmp_path))
    assert events.rdd.getNumPartitions() == metadata.rdd.getNumPartitions() == 1
    assert sorted(r.event_id for r in events.collect()) == sorted(f"{c}{i}" for c in "ef" for i in range(60))
    assert metadata.select("run_id").distinct().count() == 60
    assert [len(p.ranges) for p in jp.packed([jp.Range("a", 0, n) for n in (3, 4, 2, 9, 1, 1)], 8)] == [2, 1, 1, 2]
