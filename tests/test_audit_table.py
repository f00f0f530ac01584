"""The audit table: commits, replays and failures, and which files a micro-batch opens."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from driftwarden.streaming import audit

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("note", T.StringType()), T.StructField("at", T.TimestampType())])
AT = dt.datetime(2026, 1, 1)


def batch(*ids):
    return pa.RecordBatch.from_pydict({"event_id": list(ids), "note": [f"n{i}" for i in ids], "at": [AT] * len(ids)})


def rows_of(path):
    return sorted(i for n in audit.committed(path) for i in pq.read_table(f"{path}/data/{n}.parquet").column("event_id").to_pylist())


def test_failed_and_replayed_batches(tmp_path):
    path = str(tmp_path / "t")
    one = audit.AuditWriter(path, "event_id", "q", SCHEMA)
    lost = [one.write(iter([batch(1, 2)])), None]           # a task failed: the batch is aborted
    one.abort(lost, 0)
    assert rows_of(path) == [] and not list((tmp_path / "t" / "data").iterdir())
    orphan = one.write(iter([batch(3)]))                    # a task whose executor was lost left a file
    done = [one.write(iter([batch(1, 2, 2), batch(1)])), one.write(iter([])), one.write(iter([batch(3)]))]
    one.commit(done, 0)
    assert rows_of(path) == [1, 2, 3] and orphan.file not in audit.committed(path)
    again = [one.write(iter([batch(1, 2, 2), batch(1)]))]   # run again after the commit: nothing is new
    assert again[0].rows == 0
    one.commit([audit.Written(orphan.file, 1, 0)], 0)       # even files written before the commit was seen do not count
    assert rows_of(path) == [1, 2, 3]
    one.commit([one.write(iter([batch(3, 4)]))], 1)
    other = audit.AuditWriter(path, "event_id", "p", SCHEMA)
    other.commit([other.write(iter([batch(4, 5)]))], 0)
    assert rows_of(path) == [1, 2, 3, 4, 5]


def test_only_files_whose_filter_hits_are_opened(tmp_path):
    path = str(tmp_path / "t")
    for i in range(20):
        w = audit.AuditWriter(path, "event_id", "q", SCHEMA)
        w.commit([w.write(iter([batch(*range(i * 100, i * 100 + 100))]))], i)
    found = audit.AuditWriter(path, "event_id", "q", SCHEMA).write(iter([batch(505, 506, 5000)]))
    assert found.rows == 1 and 1 <= found.opened <= 3
    assert audit.AuditWriter(path, "event_id", "q", SCHEMA).write(iter([batch(9000)])).opened <= 2


def test_filter_has_no_false_negatives_and_few_false_positives():
    rnd = np.random.default_rng(1)
    held, others = rnd.integers(0, 1 << 63, 5000).astype(np.uint64), rnd.integers(0, 1 << 63, 20_000).astype(np.uint64)
    found = audit.bloom(held)
    assert audit.maybe_in(found, held).all() and audit.maybe_in(found, others).mean() < 0.01
    assert not audit.maybe_in(audit.bloom(held[:0]), others).any()


@pytest.mark.parametrize("key", ["event_id", "note"])
def test_streams_add_each_key_once(spark, tmp_path, key):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    assert audit.read_audit(spark, path, SCHEMA).count() == 0
    for ids in ((1, 2, 2), (2, 3)):
        spark.createDataFrame([(i, f"n{i}", AT) for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for writer in ("a", "b"):
        audit.append_to_audit(src, path, key, writer, str(tmp_path / writer)).awaitTermination()
    spark.createDataFrame([(4, "n4", AT)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    audit.append_to_audit(src, path, key, "a", str(tmp_path / "a")).awaitTermination()
    got = audit.read_audit(spark, path, SCHEMA).collect()
    assert sorted(r.event_id for r in got) == [1, 2, 3, 4] and {r["at"] for r in got} == {AT}
