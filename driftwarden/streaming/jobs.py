"""Structured Streaming jobs: hourly sessions, stateful EWMA, scoring, audit sinks.

All jobs take a streaming DataFrame and return a streaming DataFrame or a started query, so
any source and trigger can be used.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as fv
from ..functions import scores
from ..plans.event_scoring import ServingModel, prepare, score_events


def event_time(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Zone-less timestamps cast to instants, then watermarked."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def hourly_counts(events: DataFrame, measures: dict[str, Column] | None = None, ts: str = "ts") -> DataFrame:
    """Calls (and measures) per user and hour.  In append mode an hour is emitted once the
    watermark has passed it; late events are dropped."""
    extra = [m.alias(n) for n, m in (measures or {}).items()]
    return (events.groupBy(F.window(ts, "1 hour").alias("_w"), "user_id")
            .agg(F.count(F.lit(1)).alias("calls"), *extra)
            .select("user_id", F.col("_w.start").alias("hour"), F.col("_w.end").alias("hour_end"), "calls",
                    *(measures or {})))


def unique_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """First arrival of every event id within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def ewma_updates(sessions: DataFrame, value: str, lam: float = fv.EWMA_LAMBDA, key: str = "user_id",
                 time: str = "hour") -> DataFrame:
    """EWMA per user with the last state and its hour kept between micro-batches; rows of one batch are
    folded in time order.  Input: one row per user and hour.

    An hour that is not after the last one folded comes too late to take its place: it leaves the state
    alone and is returned with null EWMA values, so that it can be counted or replayed.  A table of
    hours that another stream writes has to be read without a limit of files per trigger: a micro-batch
    then holds whole commits, which come in the order of time.
    """
    key_type = dict(sessions.dtypes)[key]

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # hours of one user in one micro-batch: bounded by the trigger's time span
        pdf = pd.concat(list(frames)).sort_values(time)
        last, folded = state.get if state.exists else (None, None)
        prev, new, dev = [], [], []
        for x, hour in zip(pdf[value].astype(float), pdf[time].astype("datetime64[us]").astype("int64")):
            if folded is not None and hour <= folded:
                prev.append(None)
                new.append(None)
                dev.append(None)
                continue
            start = x if last is None else last
            prev.append(start)
            dev.append(0.0 if last is None else (x - start) / max(start, fv.EWMA_STATE_FLOOR))
            last = x if last is None else lam * x + (1.0 - lam) * start
            new.append(last)
            folded = int(hour)
        state.update((last, folded))
        yield pd.DataFrame({key: group[0], time: pdf[time], value: pdf[value].astype(float),
                            **{n: pd.Series(v, dtype=float, index=pdf.index) for n, v in
                               (("ewma_previous", prev), ("ewma_new", new), ("ewma_deviation", dev))}})

    return sessions.groupBy(key).applyInPandasWithState(
        fold, f"{key} {key_type}, {time} timestamp, {value} double, ewma_previous double, ewma_new double, "
              "ewma_deviation double", "state double, folded long", "append", GroupStateTimeout.NoTimeout)


PARTS = 32


def _looked_up(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream-static left join by a key of which a few values, not known beforehand, may hold most events.

    Every event goes to one of `PARTS` parts of its key by a hash of the whole event, and the table's rows go to all of them; a
    table that is small enough is broadcast by Spark instead.
    """
    part = F.pmod(F.xxhash64(*[c for c, t in events.dtypes if not t.startswith("map")]), F.lit(PARTS)).cast("int")
    parts = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return events.withColumn("_part", part).join(parts, [key, "_part"], "left").drop("_part")


def score_stream(events: DataFrame, baselines: DataFrame, sensitivity: Column, rate: Column,
                 beta: float = fv.SBRS_BETA, full_scale: float = 8.0) -> DataFrame:
    """Stream-static scoring: each event against its user's stored baseline; the deviation
    over `full_scale`, clipped to 0..1, is the behaviour score."""
    joined = _looked_up(events, baselines.select("user_id", "ewma_baseline"), "user_id")
    dev = scores.ewma_deviation(rate, F.col("ewma_baseline"))
    a = F.coalesce(scores.clamp(dev / F.lit(full_scale), 0.0, 1.0), F.lit(0.0))
    out = joined.withColumn("sbrs_value", scores.sbrs(sensitivity, a, beta))
    return out.withColumns({"sbrs_category": scores.band_category("sbrs_value"),
                            "action": scores.band_action("sbrs_value")})


def score_with_model(events: DataFrame, model: ServingModel, baselines: DataFrame, homes: DataFrame, path: str, checkpoint: str,
                     **trigger) -> StreamingQuery:
    """Nested events scored by the model tables, a micro-batch at a time, into folders query=/batch= below `path`.

    What is looked up per user (statistics, banks, baselines, homes) is one stored table, made with the rest of the model before
    the stream starts, so a micro-batch reads its own events, once, and that table.  A batch that is run again replaces its
    folder; a new checkpoint is a new query.
    """
    ready = prepare(model, baselines, homes)

    def sink(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.persist()
        score_events(batch, ready).write.mode("overwrite").parquet(f"{path}/query={query_id}/batch={batch_id}")
        batch.unpersist()

    return (events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def enforce(scored: DataFrame, audit_path: str, queue_path: str, checkpoint: str, key: str = "event_id",
            **trigger) -> StreamingQuery:
    """BLOCK rows to the audit table, ALERT rows to the review queue; both only grow.

    Every micro-batch owns the folder of its query and number, so a batch that is run again replaces
    itself.  A new checkpoint is a new query with folders of its own: it replaces nothing, and rows whose
    `key` another query has written are left out.  Within one query only the other queries' folders
    are read, by their key column.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        kinds = batch.select(key).schema
        batch.persist()
        for action, path in (("BLOCK", audit_path), ("ALERT", queue_path)):
            rows = batch.filter(F.col("action") == action)
            others = [q for q in _children(spark, path) if q != f"query={query_id}"]
            if others:
                written = spark.read.schema(kinds).parquet(*[f"{path}/{q}/batch=*" for q in others])
                rows = rows.join(written, key, "left_anti").select(*batch.columns)
            rows.write.mode("overwrite").parquet(f"{path}/query={query_id}/batch={batch_id}")
        batch.unpersist()

    return (scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _children(spark, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def to_table(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (df.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
