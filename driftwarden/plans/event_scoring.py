"""Batch scoring of nested events: personal data, behaviour, risk score and action.

Everything per user (baseline, home, statistics, memory bank) is first gathered into one
row per user, so the events meet user context in a single join that tolerates hot users.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from .. import fixed_values as fv
from ..functions import scores, vectors
from ..operators import events as ev, forest, joins, ordering, scoring
from ..operators.enforcement import check_parameters
from ..session import stage_table

WIDTH = len(fv.FEATURES)


@dataclass
class ServingModel:
    """Model tables: user_stats (user_id, mu_i, sd_i), scaler (one row), banks (user_id,
    hour_index, tail), forest, calibrators (name, lo, hi), params (alpha, tau_hybrid,
    tau_ewma); for events with history or an encoder also codes (user_id, hour_index, code: encoded
    unit windows), and encoder (name, row, values) unless windows are flattened."""
    user_stats: DataFrame
    scaler: DataFrame
    banks: DataFrame
    forest: DataFrame
    calibrators: DataFrame
    params: DataFrame
    codes: DataFrame | None = None
    encoder: DataFrame | None = None


def user_context(model: ServingModel, baselines: DataFrame, homes: DataFrame) -> DataFrame:
    """One row per user with all that is looked up; `homes` holds (user_id, home)."""
    stats = model.user_stats.select(
        "user_id", F.array(*[f"mu_{i}" for i in range(WIDTH)]).alias("mu"),
        F.array(*[f"sd_{i}" for i in range(WIDTH)]).alias("sd"))
    banks = model.banks.groupBy("user_id").agg(F.collect_list("tail").alias("bank"))   # capped per user
    out = ev.baseline_of_users(baselines).join(homes, "user_id", "full")
    return out.join(stats, "user_id", "full").join(banks, "user_id", "full")


def fallback_context(model: ServingModel, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Means of all users' statistics, and at most 512 bank rows, for unseen users."""
    stats = model.user_stats.agg(
        F.array(*[F.avg(f"mu_{i}") for i in range(WIDTH)]).alias("mu"),
        F.array(*[F.avg(f"sd_{i}") for i in range(WIDTH)]).alias("sd"))
    bank = ordering.capped_sample(model.banks, ["user_id", "hour_index"], [], fv.GLOBAL_BANK_CAP, seed)
    return stats, bank.agg(F.collect_list("tail").alias("bank"))


def _windows(rows: DataFrame, history: DataFrame | None) -> DataFrame:
    """`rows` with `_window`, the 24 z vectors that end with the event; hours without history are at the user's own level (0)."""
    still = F.array_repeat(F.lit(0.0), WIDTH)
    if history is None:
        return rows.withColumn("_window", F.concat(F.array_repeat(still, fv.SEQ_LEN - 1), F.array("_z")))
    # sorted, so that of an hour's rows the largest comes last
    hours = (history.filter(F.col("hours_before").between(1, fv.SEQ_LEN - 1))
             .select("event_id", F.struct(F.col("hours_before").cast("int").alias("t"), *[F.col(c).cast("double").alias(c) for c in fv.SERVING_FEATURES])
                     .alias("past"))
             .groupBy("event_id").agg(F.sort_array(F.collect_list("past")).alias("_past")))
    rows = rows.join(hours, "event_id", "left")        # one row per event on either side
    unknown = F.array_repeat(F.lit(None).cast("double"), WIDTH)
    filled = _filled_window("_past", F.coalesce("_mu", unknown), F.coalesce("_sd", unknown), "_z")
    return rows.withColumn("_window", filled).drop("_past")


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _filled_window(past: pa.Array, mu: pa.Array, sd: pa.Array, now: pa.Array) -> pa.Array:
    """Windows of z vectors from the hours before the events; a value that is not known is at the user's own level (0)."""
    out = np.zeros((len(past), fv.SEQ_LEN, WIDTH))
    event, hours = pc.list_parent_indices(past).to_numpy(), past.flatten()
    x = np.column_stack([hours.field(c).to_numpy(zero_copy_only=False) for c in fv.SERVING_FEATURES])
    missing = np.column_stack([hours.field(c).is_null().to_numpy(zero_copy_only=False) for c in fv.SERVING_FEATURES])
    mean, spread = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(past), WIDTH) for c in (mu, sd))
    missing |= (mu.flatten().is_null().to_numpy(zero_copy_only=False) | sd.flatten().is_null().to_numpy(zero_copy_only=False)
                ).reshape(len(past), WIDTH)[event]
    with np.errstate(all="ignore"):
        z = (x - mean[event]) / spread[event]
    z = np.where(np.isnan(z), fv.Z_CLIP, np.clip(z, -fv.Z_CLIP, fv.Z_CLIP))      # as in `scores.clamp`, where NaN is above all numbers
    out[event, fv.SEQ_LEN - 1 - hours.field("t").to_numpy(zero_copy_only=False).astype(int)] = np.where(missing, 0.0, z)
    out[:, -1] = now.flatten().to_numpy(zero_copy_only=False).reshape(len(now), WIDTH)
    return scoring.list_rows(out)


def _coded_distance(rows: DataFrame, model: ServingModel, history: DataFrame | None) -> DataFrame:
    """`rows` with `raw_bank` from encoded windows.  Only (row number, bank, code) go to the banks, in bounded
    chunks, and the score comes back by the row's number; unknown users share the bank of all users."""
    if model.codes is None:
        raise ValueError("history and encoders need the model's table of encoded banks (codes)")
    rows = stage_table(rows.withColumn("_row", F.monotonically_increasing_id()), "events_in_context")
    bank_of = F.when(F.col("mu").isNotNull(), F.concat(F.lit("user "), F.col("user_id").cast("string"))).otherwise("all")
    queries = _windows(rows.select("_row", bank_of.alias("_of"), "event_id", "_mu", "_sd", "_z"), history)
    if model.encoder is None:
        queries = queries.withColumn("code", F.flatten("_window"))
    else:
        queries = scoring.encode_windows(queries, "_window", scoring.encoder_weights(model.encoder)).withColumnRenamed("encoded", "code")
    everyone = ordering.capped_sample(model.codes, ["user_id", "hour_index"], [], fv.GLOBAL_BANK_CAP, 0)
    banks = (model.codes.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("_of"), "code")
             .union(everyone.select(F.lit("all").alias("_of"), "code")))
    raw = scoring.memory_bank_scores(queries.select("_row", "_of", "code"), banks, "_of", "code", ["_row"], keys=rows.select(bank_of.alias("_of")))
    return rows.join(raw.select("_row", F.col("raw").alias("raw_bank")), "_row").drop("_row")


def _tail_distance(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """`rows` with `raw_bank` for events without history, whose earlier hours are zero: their flattened
    windows meet the banks in the last hour only, six products a bank row."""
    rows = rows.withColumn("_gb", bank.scalar())
    known = F.col("mu").isNotNull()
    # six products written out: one short lambda per bank row instead of nested folds
    # the bank of all users is for unknown ones; a known user without rows of their own scores 0
    own = F.coalesce("bank", F.filter("_gb", lambda b: F.lit(False)))
    similarity = vectors.let(F.when(known, own).otherwise(F.col("_gb")), lambda rows_: F.when(F.size(rows_) > 0, F.lit(1.0) - vectors.let(
        vectors.unit(F.col("_z")), lambda h: vectors.top_k_mean(
            F.transform(rows_, lambda b: vectors.dot_fixed(h, b, WIDTH)), fv.TOPK))).otherwise(0.0))
    return rows.withColumn("raw_bank", similarity).drop("bank", "_gb")


@dataclass
class Prepared:
    """What every call of `score_events` needs of a model, worked out once: one row per user, the fallbacks, the forest on the
    executors."""
    model: ServingModel
    context: DataFrame
    stats: DataFrame
    bank: DataFrame
    forest: Broadcast


def prepare(model: ServingModel, baselines: DataFrame, homes: DataFrame) -> Prepared:
    """The model for scoring many small batches: its per-user tables are joined and stored, its forest is sent out."""
    context = user_context(model, baselines, homes)
    stats, bank = fallback_context(model)
    return Prepared(model, stage_table(context, "users"), stage_table(stats, "user_mean"), stage_table(bank, "bank_of_all"),
                    forest.shared_forest(model.forest))


def score_events(events: DataFrame, model: ServingModel | Prepared, baselines: DataFrame | None = None, alpha: float | None = None,
                 beta: float = fv.SBRS_BETA, history: DataFrame | None = None, homes: DataFrame | None = None,
                 sketched: DataFrame | None = None) -> DataFrame:
    """One nested row per event: event, pii, anomaly, sbrs, raw_enforcement.

    `sketched` holds the sketches of the events by `request.user_id`, if they were made when the events were stored.

    `model` may be a `Prepared` one, which has baselines and homes in it.
    `homes` (user_id, home) holds the users' habitual origins where `events` are only a part of
    all events, as in a micro-batch; else they are taken from `events`.

    `history` (event_id, hours_before, the six serving features in natural units) holds earlier hours of
    the event's user; those 1 to 23 hours before the event fill its window.
    """
    check_parameters(alpha, beta)
    if isinstance(model, Prepared):
        ready, model = model, model.model
    else:
        context = user_context(model, baselines, ev.home_of_users(events) if homes is None else homes)
        ready = Prepared(model, context, *fallback_context(model), forest.shared_forest(model.forest))
    coded = history is not None or model.encoder is not None
    context, stats, bank = ready.context, ready.stats, ready.bank
    keyed = events.withColumn("user_id", F.col("request.user_id"))
    if sketched is not None:
        sketched = sketched.withColumnRenamed("request_user_id", "user_id")
    rows = joins.lookup_join(keyed, context.drop("bank") if coded else context, "user_id", sketched=sketched, by=["event_id"])
    rows = rows.withColumn("_g", scoring.one_row(stats))
    known = F.col("mu").isNotNull()
    rows = rows.withColumns({"_mu": F.when(known, F.col("mu")).otherwise(F.col("_g.mu")),
                             "_sd": F.when(known, F.col("sd")).otherwise(F.col("_g.sd"))})
    # as columns of their own, the coordinates are looked up once and not wherever the distance needs them
    places = {f"_{c}_{a}": scores.city_coord(g, i) for c, g in (("here", "request.geo_location"), ("home", "home")) for i, a in enumerate(("lat", "lon"))}
    feats = ev.feature_columns(F.col("_mu")[WIDTH - 1], *places)
    rows = rows.withColumns(places).withColumns(feats).drop(*places)
    rows = rows.withColumn("_z", F.array(*[scores.zscore(F.col(c), F.col("_mu")[i], F.col("_sd")[i])
                                           for i, c in enumerate(feats)]))
    rows = _coded_distance(rows, model, history) if coded else _tail_distance(rows, bank)
    rows = rows.withColumns({"_s": scoring.one_row(model.scaler), "_p": scoring.one_row(model.params)})
    scaled = {f"g_{i}": (F.col(c) - F.col(f"_s.mu_{i}")) / F.when(F.col(f"_s.sd_{i}") == 0, 1.0).otherwise(F.col(f"_s.sd_{i}"))
              for i, c in enumerate(feats)}
    rows = forest.forest_score(rows.withColumns(scaled), ready.forest, list(scaled))
    cal = {n: scoring.one_row(model.calibrators.filter(F.col("name") == n).select("lo", "hi")) for n in ("bank", "forest")}
    rows = rows.withColumns({"_ca": cal["bank"], "_cb": cal["forest"]})
    rows = rows.withColumns({"a_lstm": scores.calibrate("raw_bank", F.col("_ca.lo"), F.col("_ca.hi")),
                             "a_if": scores.calibrate("raw_if", F.col("_cb.lo"), F.col("_cb.hi"))})
    weight = F.lit(float(alpha)) if alpha is not None else F.col("_p.alpha")
    rows = rows.withColumn("a_hybrid", scores.clamp(scores.fuse("a_lstm", "a_if", weight), 0.0, 1.0))
    pii = ev.pii_columns()
    anomaly = {"lstm_score": scores.round_even("a_lstm", 4), "isolation_forest_score": scores.round_even("a_if", 4),
               "alpha": weight, "hybrid_anomaly_score": scores.round_even("a_hybrid", 4),
               **ev.ewma_columns(F.col("_p.tau_ewma")),
               "hybrid_flagged": F.col("a_hybrid") >= F.col("_p.tau_hybrid"),
               "feature_vector": F.create_map(*[x for c in feats for x in (F.lit(c), F.col(c))])}
    return rows.select(
        ev.event_summary().alias("event"), F.struct(*[c.alias(n) for n, c in pii.items()]).alias("pii"),
        F.struct(*[c.alias(n) for n, c in anomaly.items()]).alias("anomaly"),
        scores.serving_sbrs(pii["sensitivity_score"], anomaly["hybrid_anomaly_score"], beta).alias("sbrs"),
        F.col("enforcement").alias("raw_enforcement"))
