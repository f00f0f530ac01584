"""Hourly behavioural sessions: grid, features, splits, personal and global frames.

Raw events are reduced to one row per (user, hour) by a partial aggregate before any
per-user work, so a user's series is bounded by the number of hours in the table, however
many raw events that user has.  All per-user windows share one partitioning and order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions import scores
from ..session import hash_spread

def by_user():
    return Window.partitionBy("user_id").orderBy("hour_index")


CONTEXT = fv.FEATURES[1:]


def hourly_sessions(events: DataFrame, measures: dict[str, Column], ts: str = "ts",
                    key: str = "user_id", start: Column | None = None) -> DataFrame:
    """One row per user and active hour: timestamp, hour_index, calls and the measures.
    hour_index counts hours from `start` (epoch seconds), by default the first hour of the
    table, which costs one more scan of the timestamp column."""
    if start is None:
        start = events.agg(F.unix_seconds(F.date_trunc("hour", F.min(ts)))).scalar()
    hour = F.date_trunc("hour", F.col(ts))
    rows = (events.groupBy(F.col(key).alias("user_id"), hour.alias("timestamp"))
            .agg(F.count(F.lit(1)).alias("calls"), *[m.alias(n) for n, m in measures.items()]))
    index = F.floor((F.unix_seconds("timestamp") - start) / 3600)
    return rows.withColumn("hour_index", index.cast("bigint"))


def horizon(sessions: DataFrame) -> Column:
    """Number of hours in the table, as a scalar subquery."""
    return sessions.agg(F.max("hour_index") + 1).scalar()


def dense_grid(sessions: DataFrame, defaults: dict) -> DataFrame:
    """Every user x every hour; idle hours get zero calls, `active` = false and the defaults.

    Only sessions travel, dealt by user in an explicit number of partitions, as the bytes of a shuffle say nothing about the rows
    that come out.  Idle hours are added beside them from the hours alone, gathered per user (bounded by the calendar): a filter on
    `active` leaves one of the two sides out.  The grid stays partitioned by user.  Sessions without a user or hour belong to no
    hour of the grid.
    """
    first = sessions.agg(F.min(F.unix_seconds("timestamp") - F.col("hour_index") * 3600)).scalar()
    rest = [c for c in sessions.columns if c not in ("user_id", "timestamp", "hour_index")]
    placed = F.col("user_id").isNotNull() & (F.col("hour_index") >= 0)
    hour = F.col("hour_index").cast("bigint")
    kinds = dict(sessions.dtypes)
    taken = hash_spread(sessions.select("user_id", "hour_index"), "user_id").groupBy("user_id").agg(
        F.collect_list(F.when(placed, hour)).alias("_taken"))
    hours = F.sequence(F.lit(0).cast("bigint"), horizon(sessions) - 1)
    idle = taken.select("user_id", F.explode(F.array_except(hours, "_taken")).alias("hour_index"),
                        *[F.lit(None).cast(kinds[c]).alias(c) for c in rest])
    grid = hash_spread(sessions, "user_id").filter(placed).select("user_id", hour.alias("hour_index"), *rest).unionByName(idle)
    return grid.select(
        "user_id", "hour_index",
        F.timestamp_seconds(first + F.col("hour_index") * 3600).alias("timestamp"),
        F.coalesce("calls", F.lit(0)).alias("calls"), F.col("calls").isNotNull().alias("active"),
        *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if defaults.get(c) is not None else F.col(c)
          for c in rest if c != "calls"])


def split_bounds(hours: Column) -> dict[str, Column]:
    train = F.floor(hours * fv.TRAIN_SHARE)
    fit = F.floor(train * fv.FIT_SHARE)
    return {"train_end": train, "val_end": F.floor(hours * fv.VAL_SHARE), "fit_end": fit,
            "calib_lo": fit + fv.SEQ_LEN}


def assign_splits(df: DataFrame, hours: Column) -> DataFrame:
    """Chronological 70 / 15 / 15 split, plus the FIT and CALIB parts of train."""
    b, h = split_bounds(hours), F.col("hour_index")
    return df.select(
        "*", F.when(h < b["train_end"], "train").when(h < b["val_end"], "val").otherwise("test").alias("split"),
        (h < b["fit_end"]).alias("in_fit"),
        ((h >= b["calib_lo"]) & (h < b["train_end"])).alias("in_calib"))


def _on_active(grid: DataFrame, work: Callable[[DataFrame], DataFrame], idle: dict[str, Column]) -> DataFrame:
    """`work` on the active hours of a grid, the `idle` values on the others: mostly idle users cost windows over their sessions only.
    Both sides stay partitioned by user, and a filter on `active` leaves one of them out."""
    live = F.coalesce("active", F.lit(False))
    rows = work(grid.filter(live)).withColumn("active", F.lit(True))
    others = grid.filter(~live).withColumns({**idle, "active": F.lit(False)})
    return rows.unionByName(others.select(*rows.columns))


def _activity_rate(live: DataFrame) -> DataFrame:
    """The trailing sum is a difference of two running totals: constant work per session, where a sliding frame would add up to 168
    rows again for every row.  Idle hours add nothing to it."""
    n = fv.TRAILING_HOURS

    def until(hours):
        return F.coalesce(F.sum("calls").over(by_user().rangeBetween(Window.unboundedPreceding, -hours)), F.lit(0))

    seen = F.least(F.col("hour_index"), F.lit(n))
    mean = F.coalesce(F.try_divide(until(1) - until(n + 1), seen), F.lit(1.0))
    return live.withColumn("activity_rate", scores.clamp(
        F.col("calls") / F.greatest(mean, F.lit(fv.MIN_TRAILING_RATE)), 0.0, fv.MAX_ACTIVITY_RATIO))


def activity_ratio(grid: DataFrame) -> DataFrame:
    """calls over the mean of the previous 168 hours (1.0 without history), 0 when idle.

    With fewer than six earlier hours the expanding mean covers exactly the same rows.
    """
    return _on_active(grid, _activity_rate, {"activity_rate": F.lit(0.0)})


def _time_gap(live: DataFrame) -> DataFrame:
    seconds = F.unix_seconds("timestamp")
    previous = F.last(seconds, ignorenulls=True).over(by_user().rowsBetween(Window.unboundedPreceding, -1))
    out = live.withColumn("_gap", (seconds - previous).cast("double"))
    median = F.percentile("_gap", F.lit(0.5)).over(Window.partitionBy("user_id"))
    return out.withColumn("time_gap_sec", F.coalesce("_gap", median, F.lit(fv.DEFAULT_GAP_SEC))).drop("_gap")


def time_gaps(grid: DataFrame) -> DataFrame:
    """Seconds since the user's previous active hour; the first takes the user's median gap,
    else 3600; idle hours 0."""
    return _on_active(grid, _time_gap, {"time_gap_sec": F.lit(0.0)})


def derive_features(grid: DataFrame) -> DataFrame:
    """Six behavioural features plus time gaps on the dense grid; contextual features of an
    idle hour are zero."""
    context = {
        "file_type_category": scores.lookup("file_class", fv.FILE_CLASS_ORDINAL),
        "endpoint_operation": scores.lookup("endpoint_class", fv.ENDPOINT_ORDINAL),
        **{c: F.col(c).cast("double") for c in ("geo_index", "permission_scope_delta", "collaboration_density")}}
    zero = F.lit(0.0)
    calls = {"activity_rate_per_hr": F.col("calls").cast("double")}
    return _on_active(grid, lambda live: _time_gap(_activity_rate(live)).withColumns({**calls, **context}),
                      {"activity_rate": zero, "time_gap_sec": zero, **calls, **{c: zero for c in context}})


def session_features(active: DataFrame) -> DataFrame:
    """The same features for active sessions only, without building the dense grid.

    Idle hours add nothing to a trailing sum, so a range frame over the active rows gives the
    trailing mean once it is divided by the number of hours covered.  With mostly idle users
    this is an order of magnitude fewer rows than users x hours.
    """
    n = fv.TRAILING_HOURS
    past = F.coalesce(F.sum("calls").over(by_user().rangeBetween(-n, -1)), F.lit(0))
    mean = F.when(F.col("hour_index") > 0, past / F.least(F.col("hour_index"), F.lit(n))).otherwise(1.0)
    gap = (F.col("hour_index") - F.lag("hour_index").over(by_user())) * 3600.0
    out = active.withColumns({
        "activity_rate": scores.clamp(F.col("calls") / F.greatest(mean, F.lit(fv.MIN_TRAILING_RATE)),
                                      0.0, fv.MAX_ACTIVITY_RATIO), "_gap": gap})
    median = F.percentile("_gap", F.lit(0.5)).over(Window.partitionBy("user_id"))
    return out.withColumns({
        "time_gap_sec": F.coalesce("_gap", median, F.lit(fv.DEFAULT_GAP_SEC)),
        "activity_rate_per_hr": F.col("calls").cast("double"),
        "file_type_category": scores.lookup("file_class", fv.FILE_CLASS_ORDINAL),
        "endpoint_operation": scores.lookup("endpoint_class", fv.ENDPOINT_ORDINAL)}).drop("_gap")


def session_stats(feats: DataFrame, fit_hours: Column) -> DataFrame:
    """`personal_stats` from active sessions: idle FIT hours enter dimension 0 as zeros through
    their number alone.  Users without a FIT session have no contextual mean."""
    fit = F.col("in_fit")
    aggs = [F.count_if(fit).alias("_k")]
    for i, c in enumerate(fv.FEATURES):
        v = F.when(fit, F.col(c))
        aggs += [F.avg(v).alias(f"mu_{i}"), F.var_pop(v).alias(f"_v{i}")]
    out = feats.groupBy("user_id").agg(*aggs).withColumn("_n", fit_hours.cast("double"))
    k, n, m = F.col("_k").cast("double"), F.col("_n"), F.coalesce("mu_0", F.lit(0.0))
    mean = k * m / n
    spread = (k * (F.coalesce("_v0", F.lit(0.0)) + F.pow(m - mean, 2)) + (n - k) * F.pow(mean, 2)) / n
    floor = F.lit(fv.SD_FLOOR)
    return out.select("user_id", mean.alias("mu_0"), F.greatest(F.sqrt(spread), floor).alias("sd_0"), *[
        x for i in range(1, len(fv.FEATURES)) for x in (
            F.col(f"mu_{i}"), F.greatest(F.sqrt(f"_v{i}"), floor).alias(f"sd_{i}"))])


def attach_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Name, department and platform of each session's user.  One row per user and hour on
    the left, so no key is hot; Spark broadcasts the profiles when they are small enough."""
    return df.join(profiles, "user_id", "left")


def personal_stats(grid: DataFrame) -> DataFrame:
    """Per-user mean and population deviation over FIT hours: dimension 0 over all hours, the
    contextual dimensions over active hours only; deviations floored."""
    aggs = []
    for i, c in enumerate(fv.FEATURES):
        seen = F.col("in_fit") if i == 0 else F.col("in_fit") & F.col("active")
        v = F.when(seen, F.col(c))
        aggs += [F.avg(v).alias(f"mu_{i}"),
                 F.greatest(F.stddev_pop(v), F.lit(fv.SD_FLOOR)).alias(f"sd_{i}")]
    return grid.groupBy("user_id").agg(*aggs)


def global_stats(stats: DataFrame) -> DataFrame:
    """Fallback for unseen users: the mean over users of every mean and deviation."""
    return stats.agg(*[F.avg(c).alias(c) for c in stats.columns if c != "user_id"])


def personal_frame(grid: DataFrame, stats: DataFrame) -> DataFrame:
    """z_0..z_5 per user; contextual dimensions of idle hours pinned to 0.  `idle_z` is the
    user's z_0 of an idle hour.  Works on the dense grid and on active sessions alone.

    A stored grid is so small for its rows that Spark would broadcast it: rows are dealt by user instead, in an explicit number of
    partitions, and meet the statistics there.  One row per user and hour, so no key is hot.
    """
    joined = hash_spread(grid, "user_id").join(stats.hint("shuffle_hash"), "user_id")
    z = [scores.zscore(c, f"mu_{i}", f"sd_{i}") for i, c in enumerate(fv.FEATURES)]
    live = F.col("active") if "active" in grid.columns else F.lit(True)
    return joined.select(*grid.columns, z[0].alias("z_0"), *[
        F.when(live, z[i]).otherwise(0.0).alias(f"z_{i}") for i in range(1, len(z))],
        scores.zscore(F.lit(0.0), "mu_0", "sd_0").alias("idle_z"))


def global_scaler(grid: DataFrame) -> DataFrame:
    """One row: mean and population deviation of every feature over FIT and active rows."""
    rows = grid.filter(F.col("in_fit") & (F.col("active") if "active" in grid.columns else F.lit(True)))
    return rows.agg(*[a for i, c in enumerate(fv.FEATURES) for a in (
        F.avg(c).alias(f"mu_{i}"), F.stddev_pop(c).alias(f"sd_{i}"))])


def global_frame(grid: DataFrame, scaler: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """g_0..g_5 scaled by the one-row scaler; a constant feature is only centred."""
    rows = grid if rows is None else rows
    par = rows.withColumn("_s", scaler.select(F.struct("*")).scalar())
    sd = [F.when(F.col(f"_s.sd_{i}") == 0, 1.0).otherwise(F.col(f"_s.sd_{i}"))
          for i in range(len(fv.FEATURES))]
    return par.select(*rows.columns, *[((F.col(c) - F.col(f"_s.mu_{i}")) / sd[i]).alias(f"g_{i}")
                                       for i, c in enumerate(fv.FEATURES)])


def z_vector() -> Column:
    return F.array(*[F.col(f"z_{i}") for i in range(len(fv.FEATURES))])


def history_windows(zgrid: DataFrame, length: int = fv.SEQ_LEN) -> DataFrame:
    """The full window of `length` vectors ending at each hour; short histories are dropped."""
    win = F.collect_list("vec").over(by_user().rowsBetween(-(length - 1), 0))
    return (zgrid.withColumn("vec", z_vector()).withColumn("window", win)
            .filter(F.size("window") == length))


def prediction_pairs(zgrid: DataFrame, length: int = fv.SEQ_LEN) -> DataFrame:
    """Window of the `length` hours before t, with the vector at t as target."""
    win = F.collect_list("vec").over(by_user().rowsBetween(-length, -1))
    return (zgrid.withColumn("vec", z_vector()).withColumn("window", win)
            .filter(F.size("window") == length).withColumnRenamed("vec", "target"))


def next_step_targets(zgrid: DataFrame, length: int = fv.SEQ_LEN) -> DataFrame:
    """Window ending at t with the vector at t + 1; the last hour has no target."""
    vecs = zgrid.withColumn("vec", z_vector())
    win = F.collect_list("vec").over(by_user().rowsBetween(-(length - 1), 0))
    return (vecs.withColumn("window", win).withColumn("target", F.lead("vec").over(by_user()))
            .filter((F.size("window") == length) & F.col("target").isNotNull()))


def scoreable(grid: DataFrame) -> DataFrame:
    """Active sessions with a full day of grid history."""
    live = F.col("active") if "active" in grid.columns else F.lit(True)
    return grid.filter(live & (F.col("hour_index") >= fv.SEQ_LEN - 1))
