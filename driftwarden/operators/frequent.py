"""Frequent keys of a table, kept as sketches that can be merged.

A sketch holds at most `TRACKED` values of a key column with estimated counts.  Every value with more than
4 / (3 * TRACKED) of the rows is in it, so the keys above any share that is larger than that are found in one pass,
without a shuffle of the rows and in bounded memory.  The pass can be the one that writes a stage table
(`stage_with_sketches`); sketches of parts of a table, such as its days, add up (`merged`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..session import stage_table

TRACKED = 4096
HEAVY_SHARE = 0.005


def _quoted(column: str) -> str:
    return ".".join(f"`{part}`" for part in column.split("."))


def _name(column: str) -> str:
    return column.replace(".", "_")


def _aggregates(keys: Sequence[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"),
            *[F.expr(f"approx_top_k_accumulate({_quoted(k)}, {TRACKED})").alias(_name(k)) for k in keys]]


def sketches(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: `rows` and a sketch per key column."""
    return df.agg(*_aggregates(keys))


def stage_through(rows: DataFrame, keys: Sequence[str], name: str, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The stage table `build(rows)` and the sketches of `rows`, both from the one job that writes the table.

    `build` must read its rows once.
    """
    seen = Observation()
    staged = stage_table(build(rows.observe(seen, *_aggregates(keys))), name)
    found, schema = seen.get, sketches(rows, keys).schema
    return staged, rows.sparkSession.createDataFrame([tuple(found[f.name] for f in schema)], schema)


def stage_with_sketches(df: DataFrame, name: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The stage table of `df` and its sketches."""
    return stage_through(df, keys, name, lambda rows: rows)


def merged(parts: DataFrame) -> DataFrame:
    """Sketches of a whole table from those of its parts, one row each."""
    # grouped, as the combination fails on partitions without rows
    whole = parts.groupBy(F.lit(0).alias("_all")).agg(F.sum("rows").alias("rows"), *[
        F.expr(f"approx_top_k_combine(`{c}`, {TRACKED})").alias(c) for c in parts.columns if c != "rows"])
    return whole.drop("_all")


def frequent(sketched: DataFrame, key: str, share: float = HEAVY_SHARE) -> Column:
    """The key's values with `share` of the rows or more, as an array: a scalar subquery over one row of sketches.

    Counts are estimates that may be too large by a small part of `share`; at most about 1 / share values are listed, and null never is.
    """
    most = int(1 / share) + 1
    listed = F.expr(f"approx_top_k_estimate(`{_name(key)}`, {most})")
    often = F.filter(listed, lambda x: x["item"].isNotNull() & (x["count"] >= F.col("rows") * share))
    return sketched.select(F.transform(often, lambda x: x["item"])).scalar()
