"""Order statistics that stay distributed.

A window without PARTITION BY sorts a whole table in one task, and the exact
`percentile` aggregate holds every distinct value of a group in one hash map.  Here equal
values are first collapsed to one row, the rest is cut into value ranges at sampled cut
points, and running totals are the offset of a range plus a running total inside it.  A
group of any size is spread over as many tasks as there are ranges, and the result is
exact whatever the cut points are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES = 64


def _ranges(df: DataFrame, ranges: int | None) -> int:
    """As many ranges as a shuffle has partitions, so they grow with the cluster's own setting."""
    return ranges or max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _place(cuts: str, heads: str, value: str, step: int) -> Column:
    """How many of the sorted `cuts` are not above the value: first among `heads`, every `step`-th, then in the stretch after it."""
    start = F.greatest(F.size(F.filter(heads, lambda c: c <= F.col(value))) - 1, F.lit(0)) * step
    return start + F.size(F.filter(F.slice(cuts, start + 1, F.lit(step)), lambda c: c <= F.col(value)))


def running_totals(df: DataFrame, value: str, weights: dict[str, Column],
                   by: Sequence[str] = (), ranges: int | None = None, few_groups: bool = False) -> DataFrame:
    """One row per (by, value) with summed weights, `<w>_before` = total over smaller values
    and `<w>_total` = total of the group.

    Cut points: a uniform sample of about `ranges` distinct values of each group, those with the smallest
    hashes of each of sqrt(`ranges`) slices, so that no task sees every partition's candidates.  Cut points and range offsets take at most `ranges` + 1 rows
    per group.  They are broadcast when there is no grouping, or when the caller knows that the
    groups are a handful of labels (`few_groups`); otherwise Spark picks the join by their
    measured size.
    """
    by, n = list(by), _ranges(df, ranges)
    names = list(weights)
    distinct = (df.filter(F.col(value).isNotNull())
                .groupBy(*by, value).agg(*[w.alias(k) for k, w in weights.items()]))

    step = math.isqrt(n - 1) + 1
    sample_order = Window.partitionBy(*by, "_slice").orderBy(F.xxhash64(F.col(value), F.lit(1)))
    # the weights are carried along so that this branch reads the same shuffle as the others
    sampled = (distinct.withColumn("_slice", F.pmod(F.xxhash64(F.col(value)), F.lit(step)))
               .withColumn("_rn", F.row_number().over(sample_order)).filter(F.col("_rn") <= -(-n // step))
               .groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(value, *names))).alias("_cuts"))
               .withColumn("_cuts", F.transform("_cuts", lambda s: s[value]))
               .withColumn("_heads", F.filter("_cuts", lambda c, i: i % step == 0)))

    def attach(left, right, keys):
        right = F.broadcast(right) if few_groups or not by else right
        return left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])

    if by:
        ranged = attach(distinct.alias("l"), sampled.alias("r"), by)
        ranged = ranged.select("l.*", "r._cuts", "r._heads")
    else:
        ranged = (distinct.withColumn("_both", sampled.select(F.struct("_cuts", "_heads")).scalar())
                  .select("*", "_both._cuts", "_both._heads").drop("_both"))
    ranged = ranged.withColumn("_range", _place("_cuts", "_heads", value, step)).drop("_cuts", "_heads")

    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range")
    offsets = (ranged.groupBy(*by, "_range").agg(*[F.sum(k).alias(k) for k in names]))
    offsets = offsets.select(
        *by, "_range",
        *[F.coalesce(F.sum(k).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
          .alias(f"{k}_offset") for k in names],
        *[F.sum(k).over(Window.partitionBy(*(by or [F.lit(0)]))).alias(f"{k}_total") for k in names])

    inside = (Window.partitionBy(*by, "_range").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.select("*", *[F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"{k}_local")
                                 for k in names])
    joined = attach(local.alias("l"), offsets.alias("r"), by + ["_range"])
    return joined.select(
        *[F.col(f"l.{c}") for c in by], F.col(f"l.{value}"), *[F.col(f"l.{k}") for k in names],
        *[(F.col(f"r.{k}_offset") + F.col(f"l.{k}_local")).alias(f"{k}_before") for k in names],
        *[F.col(f"r.{k}_total") for k in names])


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
              ranges: int | None = None, few_groups: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group, one column per name."""
    rows = running_totals(df, value, {"n": F.count(F.lit(1))}, by, ranges, few_groups)
    picks = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("n_total") - 1)
        for side, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_{name}_w"))
    out = rows.groupBy(*by).agg(*picks)
    return out.select(*by, *[
        (F.col(f"_{m}_lo") + (F.col(f"_{m}_hi") - F.col(f"_{m}_lo")) * F.col(f"_{m}_w")).alias(m)
        for m in probs])


def rank_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
             ranges: int | None = None, few_groups: bool = False) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties; NaN when a side is empty."""
    rows = running_totals(
        df, score, {"pos": F.count_if(F.col(label)), "neg": F.count_if(~F.col(label))}, by, ranges, few_groups)
    wins = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2)
    out = rows.groupBy(*by).agg(F.sum(wins).alias("_wins"), F.max("pos_total").alias("n_pos"),
                                F.max("neg_total").alias("n_neg"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return out.select(*by, "n_pos", "n_neg",
                      F.when(pairs > 0, F.try_divide(F.col("_wins"), pairs))
                      .otherwise(F.lit(float("nan"))).alias("auc"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their tie-averaged rank (1-based)."""
    rows = running_totals(df, value, {"n": F.count(F.lit(1))}, by)
    return rows.select(*by, value, "n",
                       (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank"))


def positions(df: DataFrame, keys: Sequence[str], by: Sequence[str] = (),
              name: str = "position", few_groups: bool = False) -> DataFrame:
    """1-based position of every row in the order of unique `keys` (within `by`)."""
    keyed = df.select(*by, F.struct(*keys).alias("_key"))
    rows = running_totals(keyed, "_key", {"n": F.count(F.lit(1))}, by, few_groups=few_groups)
    return rows.select(*by, *[F.col("_key")[k].alias(k) for k in keys],
                       (F.col("n_before") + 1).alias(name), F.col("n_total").alias("group_size"))


def interleave(df: DataFrame, category: str, first: str, second: str, key: str) -> DataFrame:
    """Round-robin order of two categories, the longer one's remainder appended."""
    pos = positions(df.filter(F.col(category).isin(first, second)), [key], [category], "rn", few_groups=True)
    sizes = (pos.groupBy().agg(
        F.coalesce(F.max(F.when(F.col(category) == first, F.col("group_size"))), F.lit(0)).alias("a"),
        F.coalesce(F.max(F.when(F.col(category) == second, F.col("group_size"))), F.lit(0)).alias("b"))
        .select(F.least("a", "b")).scalar())
    paired = F.col("rn") <= sizes
    return pos.select(category, key, "rn", F.when(
        paired, F.col("rn") * 2 - F.when(F.col(category) == first, 1).otherwise(0))
        .otherwise(F.col("rn") + sizes).alias("call_order"))


def stratified_sample(df: DataFrame, key: str, category: str, fraction: float, seed: int) -> DataFrame:
    """rint(n * fraction) keys per category: those with the smallest seeded digest."""
    tagged = df.select(category, key).withColumn(
        "_pick", F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))).alias("d"),
                          F.col(key).alias("key")))
    rows = running_totals(tagged, "_pick", {"n": F.count(F.lit(1))}, [category])
    quota = F.rint(F.col("n_total") * F.lit(float(fraction)))
    return rows.filter(F.col("n_before") < quota).select(category, F.col("_pick.key").alias(key))


def capped_sample(df: DataFrame, key_cols: Sequence[str], by: Sequence[str], cap: int,
                  seed: int, bounded_groups: bool = False) -> DataFrame:
    """At most `cap` rows per group without replacement: smallest seeded digests win.

    Unless the groups are known to be small, a group is first cut into slices by digest and
    every slice keeps its `cap` best, so even a group with most of the table reaches its last
    task as at most SLICES x cap rows.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))
    rows, groups = df.withColumn("_digest", digest), list(by) or [F.lit(0)]

    def best(rows, *partition):
        order = Window.partitionBy(*partition).orderBy("_digest", *key_cols)
        return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= cap).drop("_rn")

    if not by:
        # whole rows are ranked once the largest digest to be kept is known, which takes the keys only
        slim = rows.select("_digest", *key_cols).withColumn("_slice", F.pmod(F.xxhash64("_digest"), F.lit(SLICES)))
        rows = rows.filter(F.col("_digest") <= best(best(slim, "_slice"), *groups).agg(F.max("_digest")).scalar())
    elif not bounded_groups:
        rows = best(rows.withColumn("_slice", F.pmod(F.xxhash64("_digest"), F.lit(SLICES))), *groups, "_slice").drop("_slice")
    return best(rows, *groups).drop("_digest")
