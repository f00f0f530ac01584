"""Joins of a large fact table with per-key tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from . import frequent as fq
from .frequent import HEAVY_SHARE

SLOTS = 64          # parts of a hot key


def heavy_keys(facts: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys holding `share` of the rows or more, by a sketch of the table; at most 1 / share of them can exist."""
    return facts.sparkSession.range(1).select(F.explode(fq.frequent(fq.sketches(facts, [key]), key, share)).alias(key))


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, share: float = HEAVY_SHARE, sketched: DataFrame | None = None,
                by: Sequence[str] | None = None) -> DataFrame:
    """Left join of facts with a table that has one row per key, safe for hot keys.

    The facts are evaluated once, and their key column once more unless `sketched` holds the facts' sketches.  Rows of a
    frequent key, whether or not the table has it, and rows without a key, which match nothing, are dealt over `SLOTS`
    parts by a hash of the columns `by` (all of the facts' own, if not given); a frequent key's row of the table goes to each part,
    so at most SLOTS / share rows are added.  Spark broadcasts a table that is small enough.
    """
    values = [c for c in dim.columns if c != key]
    hot = fq.frequent(fq.sketches(facts, [key]) if sketched is None else sketched, key, share)
    simple = [c for c, t in facts.dtypes if not t.startswith("map")]
    part = F.pmod(F.xxhash64(*(by or simple)), F.lit(SLOTS)).cast("int")
    often = F.col(key).isNull() | F.array_contains(hot, F.col(key))
    parts = F.when(F.array_contains(hot, F.col(key)), F.sequence(F.lit(0), F.lit(SLOTS - 1))).otherwise(F.array(F.lit(0)))
    table = dim.filter(F.col(key).isNotNull()).select(key, *values, F.explode(parts).alias("_part"))
    rows = facts.withColumn("_part", F.when(often, part).otherwise(0))
    return rows.join(table, [key, "_part"], "left").select(*facts.columns, *values)


def with_fallback(df: DataFrame, per_key: DataFrame, key: str, fallback: DataFrame) -> DataFrame:
    """Per-key values with the one-row fallback for unseen keys."""
    values = [c for c in per_key.columns if c != key]
    whole = fallback.select(F.struct(*values)).scalar()
    joined = lookup_join(df, per_key, key).withColumn("_fallback", whole)
    return joined.select(*df.columns, *[F.coalesce(F.col(c), F.col("_fallback")[c]).alias(c)
                                        for c in values])


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key in the given order; a partial aggregate, no sort of the group."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(key, *[F.col("_r")[c].alias(c) for c in rest]))


def value_counts(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n, first_seen): how often a key has each value, and where it first does; rows without either are left out."""
    return (df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
            .groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")))


def modal_of_counts(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; ties go to the value seen first."""
    return (counts.groupBy(key)
            .agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("first_seen"))).alias("_m"))
            .select(key, F.col("_m")[value].alias(value), F.col("_m.n").alias("n")))


def modal_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent value per key; ties go to the value seen first."""
    return modal_of_counts(value_counts(df, key, value, order), key, value)
