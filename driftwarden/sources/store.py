"""A partitioned table that is refreshed in place: only partitions in which a row changes are written again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage_table


def create(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """A new partitioned table; rows are dealt by partition first, so each has few files."""
    df.repartition(*by).write.partitionBy(*by).parquet(path)


def _digest(columns: Sequence[str]):
    return F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in columns])


def refresh(spark: SparkSession, path: str, by: Sequence[str], change: Callable[[DataFrame], DataFrame], schema=None) -> DataFrame:
    """Recompute columns row by row and rewrite the partitions that this changes; returns (by, rows, changed) of every partition.

    `change` returns its input's columns, some with new values, and leaves rows and the columns `by` alone.  The new rows of changed
    partitions are written to a stage table, and from there into the place of the old ones, all at once per job, by
    dynamic partition overwrite: other partitions are not touched.
    """
    stored = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    columns = stored.columns
    both = change(stored.withColumn("_old", _digest(columns))).withColumn("_new", _digest(columns))
    report = stage_table(both.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col("_old") != F.col("_new")).alias("changed")), "changes")
    touched = report.filter("changed > 0").select(*[F.col(c).alias(f"_{c}") for c in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    fresh = change(stored).select(*columns).join(touched, same, "left_semi")         # as many rows as there are partitions
    fresh = stage_table(fresh, "fresh")
    if not touched.isEmpty():
        fresh.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return report
