"""Connected components of an edge table by alternating star contraction.

Links are first contracted within each task, in bounded runs.  Then every step is two aggregations and a
join on narrow rows, written to a stage table, so neither a component nor the edge list ever
meets in one task or on the driver.  It ends when the links are stars: every node has one link, to a
node without one.  The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame, functions as F

from driftwarden.session import stage_table

RUN = 500_000       # links that a task contracts at once


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links -> (node, smallest node reachable over the links of the same run)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars() -> pd.DataFrame:
        rows = [(x, root(x)) for x in list(parent) if root(x) != x]
        parent.clear()
        return pd.DataFrame(rows, columns=["a", "b"])

    seen = 0
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += len(pdf)
        if seen >= RUN:
            yield stars()
            seen = 0
    yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour is linked to the least node around; small star: every smaller one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.filter("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = near.join(least, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _only_stars(edges: DataFrame) -> bool:
    ends = edges.select("a", F.lit(1).alias("low"), F.lit(0).alias("high")).union(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    per = ends.groupBy("a").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return per.filter("low > 1 or (low > 0 and high > 0)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long); the component is its smallest node.

    Self-links, repeated and reversed links are fine; links with a null end are ignored; no
    links give no rows.
    """
    edges = stage_table(edges.select("a", "b").filter("a <> b").mapInPandas(_contract, "a long, b long").distinct(), "links")
    while not _only_stars(edges):
        edges = stage_table(_star(_star(edges, True), False), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
