"""Queries over nested event documents and the per-event part of scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import scores, text as tx
from . import joins, pii

LISTED = ("user_id", "user_name", "department", "platform", "file_name", "file_type", "api_action")


def list_events(events: DataFrame, event_type: str | None = None, limit: int | None = 100) -> DataFrame:
    """Flat listing with an optional type filter; the first `limit` rows (1..1000)."""
    from .enforcement import check_parameters
    check_parameters(limit=limit)
    rows = events if event_type is None else events.filter(F.col("event_type") == event_type)
    flat = rows.select("event_id", "timestamp", "event_type", "module",
                       *[F.col(f"request.{c}").alias(c) for c in LISTED],
                       F.col("enforcement.action").alias("enforcement_action"))
    return flat if limit is None else flat.limit(limit)


def get_event(events: DataFrame, event_id: str) -> DataFrame:
    """The event with this id; a KeyError when there is none."""
    found = events.filter(F.col("event_id") == event_id)
    if found.isEmpty():
        raise KeyError(f"Unknown event_id '{event_id}'")
    return found


def event_ids(events: DataFrame) -> DataFrame:
    return events.select("event_id")


def service_summary(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.lit("driftwarden").alias("service"), F.lit(fv.SERVICE_VERSION).alias("version"),
                           "run_id", "saas_platforms", "users_monitored", "total_events", "pii_branches",
                           "anomaly_engines")


def event_summary() -> Column:
    """Flat event fields, '?' for every missing one (empty timestamp)."""
    def known(c):
        return F.coalesce(F.col(c), F.lit("?")).alias(c.split(".")[-1])
    return F.struct(known("event_id"), F.coalesce("timestamp", F.lit("")).alias("timestamp"),
                    *[known(f"request.{c}") for c in LISTED], known("event_type"))


def alias_of(user_id: Column, default: str = fv.DEFAULT_ALIAS) -> Column:
    return scores.lookup(user_id, fv.USER_ALIASES, default)


def nearest_to_target(events: DataFrame, order: str = "event_id", target: int = fv.TARGET_SENSITIVITY) -> DataFrame:
    """The event whose sensitivity (missing = 0) is nearest the target, first in order."""
    s = F.coalesce(F.col("pii_detection.sensitivity_score"), F.lit(0))
    return events.withColumn("_d", F.abs(s - target)).orderBy("_d", order).limit(1).drop("_d")


# --- personal data of an event -------------------------------------------------------
def normalised_entities(entities: Column) -> Column:
    """Full five-field entities: tier upper-cased (default LOW), weight from the tier (unknown
    1), contribution = weight x count; given values win."""
    def full(e):
        tier = F.upper(F.coalesce(e["sensitivity_tier"], F.lit("LOW")))
        count = F.coalesce(e["count"], F.lit(0))
        weight = F.coalesce(e["weight"], scores.lookup(tier, fv.ENTITY_WEIGHTS, 1).cast("bigint"))
        return F.struct(F.coalesce(e["type"], F.lit("UNKNOWN")).alias("type"), count.alias("count"),
                        tier.alias("sensitivity_tier"), weight.alias("weight"),
                        F.coalesce(e["contribution"], weight * count).alias("contribution"))
    return F.transform(F.coalesce(entities, F.array()), full)


def derivation_check(events: DataFrame) -> DataFrame:
    """Entities stating weight and contribution: how many, how many were derived instead, and
    how many disagree with the derivation."""
    e = events.select(F.explode("pii_detection.entities_detected").alias("e"))
    tier = F.upper(F.coalesce("e.sensitivity_tier", F.lit("LOW")))
    weight = scores.lookup(tier, fv.ENTITY_WEIGHTS, 1)
    stated = F.col("e.weight").isNotNull() & F.col("e.contribution").isNotNull()
    differs = (F.col("e.weight") != weight) | (F.col("e.contribution") != weight * F.coalesce("e.count", F.lit(0)))
    return e.agg(F.count_if(stated).alias("verified"), F.count_if(~stated).alias("derived"),
                 F.count_if(stated & differs).alias("mismatches"))


def pii_columns() -> dict[str, Column]:
    """Per-event sensitivity: counts, reported or recomputed score, category, branch."""
    p = "pii_detection."
    counts = {t: F.coalesce(F.col(f"{p}{t}_count"), F.lit(0)) for t in ("high", "medium", "low")}
    recomputed = scores.sensitivity(*counts.values())
    reported = F.col(f"{p}sensitivity_score")
    score = F.when(reported >= 0, reported.cast("int")).otherwise(recomputed)
    confidence = tx.parse_number(F.col(f"{p}ocr_confidence"))
    branch = F.coalesce(F.when(F.col("module") != "", F.col("module")),
                        F.when(F.col(f"{p}branch") != "", F.col(f"{p}branch")),
                        pii.serving_branch(F.col("request.file_type"), confidence))
    return {"engine": F.coalesce(f"{p}engine", F.lit(fv.PII_ENGINE)), "branch": branch, "ocr_confidence": confidence,
            "ocr_threshold": F.lit(fv.OCR_TAU), "entities_detected": normalised_entities(F.col(f"{p}entities_detected")),
            **{f"{t}_count": c for t, c in counts.items()},
            "formula": F.lit("min(10*H + 5*M + 1*L, 100)"), "sensitivity_score": score,
            "risk_category": F.coalesce(f"{p}risk_category", scores.risk_category(score)),
            "processing_ms": F.coalesce(f"{p}processing_ms", F.lit(0.0))}


# --- per-user context ------------------------------------------------------------------
def baseline_of_users(baselines: DataFrame, position: str = "position") -> DataFrame:
    """Activity baseline per user: the last '1h' row, else the user's last row; the current
    value when positive and finite, else the stored baseline, else null."""
    value = F.coalesce(scores.positive_or_null("current_ewma"), scores.positive_or_null("baseline_ewma"))
    best = F.max_by(F.struct(value.alias("v")), F.struct(F.col("time_window") == "1h", F.col(position)))
    return baselines.groupBy("user_id").agg(best.alias("_b")).select("user_id", F.col("_b.v").alias("ewma_baseline"))


def origin_counts(events: DataFrame, order: str = "event_id") -> DataFrame:
    """How often each user's events come from each place; counts of parts of the events can be added up."""
    geo = events.select(F.col("request.user_id").alias("user_id"), F.col("request.geo_location").alias("home"), order)
    return joins.value_counts(geo.filter(F.col("home") != ""), "user_id", "home", order)


def home_of_counts(counts: DataFrame) -> DataFrame:
    return joins.modal_of_counts(counts, "user_id", "home").drop("n")


def home_of_users(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Most frequent origin per user, first seen on ties."""
    return home_of_counts(origin_counts(events, order))


def feature_columns(collab: Column, *places) -> dict[str, Column]:
    """The six behavioural features of an event, rounded to 4 dp.  Expects `ewma_baseline` and
    `home` next to the event; `places` are columns with its and the home's latitude and longitude, if they were looked up before."""
    r = "request."
    lat, lon, home_lat, home_lon = places or (scores.city_coord(g, i) for g in (f"{r}geo_location", "home") for i in (0, 1))
    raw = (scores.activity_ratio(f"{r}activity_rate_per_hour", "ewma_baseline"),
           scores.file_class_of_sensitivity("pii_detection.sensitivity_score"),
           scores.geo_index(lat, lon, home_lat, home_lon), scores.endpoint_of_action(f"{r}api_action"),
           scores.scope_delta(f"{r}file_department", f"{r}department"), collab)
    return {n: scores.round_even(c, 4) for n, c in zip(fv.SERVING_FEATURES, raw)}


def ewma_columns(tau_ewma) -> dict[str, Column]:
    """One EWMA step against the stored baseline; null without a rate or a baseline."""
    x, prev = F.col("request.activity_rate_per_hour"), F.col("ewma_baseline")
    return {"ewma_score": scores.round_even(scores.ewma_step(x, prev), 4),
            "ewma_flagged": scores.ewma_deviation(x, prev) > scores._c(tau_ewma)}
