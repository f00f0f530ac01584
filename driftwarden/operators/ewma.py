"""Exponentially weighted baselines as a scan over a tree of blocks.

The effect of consecutive rows on the running state is affine (state -> decay * state + gain), and such maps compose.
A series is cut into blocks of consecutive time steps, blocks into blocks of blocks, and so on.  Going up, every
node's map is composed of its children's; going down, every node hands its children the state that
they begin with; at the bottom the rows of a block are replayed from it.  A task holds one node's children.
Only key, time step and value travel.  The closed form that divides by (1 - lambda) ** t is not
used: it overflows on long series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import scores, vectors
from ..session import hash_spread, stage_table

BLOCK, FAN, LEVELS = 512, 512, 1


def _composed(kids: Column) -> tuple[Column, Column]:
    """(gain, decay) of the maps of an array, one after the other."""
    whole = F.aggregate(kids, F.struct(F.lit(0.0).alias("g"), F.lit(1.0).alias("d")), lambda s, k: F.struct(
        (k["d"] * s["g"] + k["g"]).alias("g"), (k["d"] * s["d"]).alias("d")))
    return whole["g"], whole["d"]


def _begins(kids: Column, start: Column) -> Column:
    """The state that each map of an array begins with."""
    after = vectors.running(kids, start, lambda s, k: k["d"] * s + k["g"])
    return vectors.let(after, lambda a: F.concat(F.array(start), F.slice(a, 1, F.size(a) - 1)))


def block_starts(blocks: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(k, b, start): the state before every block of a key, from its (k, b, first, g, d): first value, gain and decay.

    The state before a key's first block is its first value.  `levels` of nodes with `fan` children stand above the blocks; one node
    per key, the top, holds what is left: one child for each block * fan ** levels time steps that have rows.
    """
    tiers = [blocks.select("k", "b", "first", "g", "d")]
    child = F.array_sort(F.collect_list(F.struct("b", "g", "d", "first")))
    for _ in range(levels):
        up = tiers[-1].groupBy("k", F.floor(F.col("b") / fan).alias("p")).agg(child.alias("kids"))
        gain, decay = _composed(F.col("kids"))
        tiers.append(up.select("k", F.col("p").alias("b"), "kids", F.col("kids")[0]["first"].alias("first"), gain.alias("g"), decay.alias("d")))
    top = tiers[-1].groupBy("k").agg(child.alias("kids")).withColumn("start", F.col("kids")[0]["first"])

    def down(nodes):
        zipped = F.arrays_zip(F.col("kids.b").alias("b"), _begins(F.col("kids"), F.col("start")).alias("start"))
        return nodes.select("k", F.inline(zipped))

    starts = down(top)
    for tier in reversed(tiers[1:]):
        starts = down(tier.select("k", "b", "kids").join(starts, ["k", "b"]))
    return starts


ADDED = ("ewma_previous", "ewma_new", "ewma_deviation")


def steps(df: DataFrame, value: str, key: str = "user_id", order: str = "hour_index", lam: float | str = fv.EWMA_LAMBDA,
          block: int = BLOCK, fan: int = FAN, levels: int = LEVELS, per_block: dict[str, Callable] | None = None) -> DataFrame:
    """(key, order, value as double, ewma_previous, ewma_new, ewma_deviation) for one row per (key, order).

    The first row of a key seeds the state and has deviation 0.  `order` must be an integer time step, unique within the key; rows
    without key or value are left out.  `lam` may name a column that is constant per key.  Series that cover more than
    block * fan ** levels steps (30 years of hours) many times should pass more levels.  `df` is evaluated once, and its blocks are
    written to a stage table.  `per_block` names further
    columns with an aggregate each, whose value for the block comes with every row.
    """
    further = per_block or {}
    rate = F.col("lam") if isinstance(lam, str) else F.lit(float(lam))
    kept = F.lit(1.0) - rate if isinstance(lam, str) else F.lit(1.0 - lam)
    narrow = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(
        *further, F.col(key).alias("k"), F.floor(F.col(order) / block).alias("b"), F.col(order).alias("t"), F.col(value).cast("double").alias("x"),
        *([F.col(lam).cast("double").alias("lam")] if isinstance(lam, str) else []))
    blocks = narrow.groupBy("k", "b").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("run"),
                                          *([F.max("lam").alias("lam")] if isinstance(lam, str) else []),
                                          *[fn(c).alias(c) for c, fn in further.items()])
    gain = F.aggregate("run", F.lit(0.0), lambda s, r: rate * r["x"] + kept * s)
    blocks = stage_table(blocks.select("*", F.col("run")[0]["x"].alias("first"), gain.alias("g"), F.pow(kept, F.size("run")).alias("d")), "ewma_blocks")
    # a block is few bytes for the rows that come out of it: it is neither broadcast nor coalesced with others by its size
    carried = hash_spread(blocks, "k", "b").join(block_starts(blocks, fan, levels).hint("shuffle_hash"), ["k", "b"])
    after = vectors.running(F.col("run"), F.col("start"), lambda s, r: rate * r["x"] + kept * s)
    replayed = vectors.let(after, lambda a: F.arrays_zip(
        F.col("run.t").alias("t"), F.col("run.x").alias("x"),
        F.concat(F.array("start"), F.slice(a, 1, F.size(a) - 1)).alias("p"), a.alias("n")))
    return carried.select(F.col("k").alias(key), *further, F.inline(replayed)).select(
        key, *further, F.col("t").alias(order), F.col("x").alias(value), F.col("p").alias("ewma_previous"), F.col("n").alias("ewma_new"),
        scores.ewma_deviation(F.col("x"), F.col("p")).alias("ewma_deviation"))


def ewma_stream(df: DataFrame, value: str, key: str = "user_id", order: str = "hour_index", lam: float | str = fv.EWMA_LAMBDA,
                block: int = BLOCK, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """`df` with the columns that `steps` adds.

    Rows without a key are dropped; a row without a value leaves the state alone and has no EWMA values.  The columns
    come back by a join, which evaluates `df` once more: pass a stored table.
    """
    rows = df.filter(F.col(key).isNotNull())
    found = steps(rows, value, key, order, lam, block, fan, levels).drop(value)
    return rows.join(found, [key, order], "left").select(key, order, *[c for c in df.columns if c not in (key, order)], *ADDED)


def horizon_baselines(events: DataFrame, value: str, ts: str = "ts", key: str = "user_id",
                      windows=fv.EWMA_WINDOWS, threshold: float = fv.LEGACY_EWMA_TAU) -> DataFrame:
    """Per user and horizon: EWMA over the sums of consecutive time buckets.

    baseline = state before the last bucket, current = state after it,
    deviation = |current - baseline| / baseline, ANOMALOUS above the threshold.
    """
    base_seconds = min(w[2] for w in windows)
    fine = (events.groupBy(key, F.floor(F.unix_seconds(ts) / base_seconds).alias("_slot"))
            .agg(F.sum(value).alias("_v"), F.max(ts).alias("_last")))
    spec = F.array(*[F.struct(F.lit(n).alias("time_window"), F.lit(l).alias("lambda"),
                              F.lit(s // base_seconds).alias("slots")) for n, l, s in windows])
    # a user's slots, bounded by the calendar, are dealt before they are repeated for every horizon
    buckets = (hash_spread(fine, key).withColumn("w", F.explode(spec))
               .groupBy(key, "w", F.floor(F.col("_slot") / F.col("w.slots")).alias("bucket"))
               .agg(F.round(F.sum("_v"), 2).alias("x"), F.max("_last").alias("_last")))
    series = buckets.select(F.struct(key, F.col("w.time_window").alias("time_window"), F.col("w.lambda").alias("lambda")).alias("series"),
                            F.col("w.lambda").alias("lambda"), "bucket", "x", "_last")
    run = steps(series, "x", "series", "bucket", "lambda", per_block={"_last": F.max})
    last = run.groupBy("series").agg(F.max_by(F.struct("ewma_previous", "ewma_new"), "bucket").alias("r"), F.max("_last").alias("last_updated"))
    deviation = F.abs(F.col("r.ewma_new") - F.col("r.ewma_previous")) / F.greatest(
        F.col("r.ewma_previous"), F.lit(fv.EWMA_STATE_FLOOR))
    return last.select(
        F.col("series")[key].alias(key), "series.time_window", F.col("series.lambda").alias("lambda"),
        F.col("r.ewma_previous").alias("baseline_ewma"), F.col("r.ewma_new").alias("current_ewma"),
        deviation.alias("deviation_ratio"), F.lit(threshold).alias("anomaly_threshold"),
        F.when(deviation > threshold, "ANOMALOUS").otherwise("NORMAL").alias("status"),
        "last_updated")
