"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "driftwarden", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per application, so that Python workers find them wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="driftwarden-code-"), "driftwarden.zip")     # served by the driver
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="driftwarden-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local checkpoint."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    Used between the stages of a long job: later plans start from a columnar table (with
    column pruning and filter pushdown) instead of repeating the whole lineage, and a lost
    executor costs only the tasks it ran.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """`stage_table` with aggregates of its rows, which the writing job itself works out."""
    seen = Observation()
    staged = stage_table(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), name)
    return staged, seen.get


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core before expensive
    per-row work; wide scans are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hash_spread(df: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """Shuffle by key into the configured number of partitions, for Python work per group.

    It takes the place of the grouping's own shuffle; an explicit number keeps small but
    expensive groups from being coalesced into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(n, most) if most else n, *keys)


def map_runs(df: DataFrame, key: str, order: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply `fn` to each key's rows in order, many keys per Arrow batch.

    For many small groups this avoids one Arrow stream per group.  A key that goes on in the
    next batch is held back, so a task holds one batch and the rows of one key.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            ids = pdf[key].to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(1, int)
            done = [fn(pdf.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            held = pdf.iloc[starts[-1]:]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None and len(held):
            yield fn(held)

    return hash_spread(df, key).sortWithinPartitions(key, order).mapInPandas(run, schema)
