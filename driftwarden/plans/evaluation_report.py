"""The metric document of a scored table: one nested row, written as JSON and read back by
`sources.tables.read_metrics`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import reports

SCORES = ("a_lstm", "a_if", "a_hybrid")


def keyed(df: DataFrame, key: str) -> Column:
    """A small report as a map from its key column to a struct of the others."""
    rest = [c for c in df.columns if c != key]
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.struct(*rest).alias("v"))))
    return df.agg(F.map_from_entries(entries)).scalar()


def single(df: DataFrame) -> Column:
    return df.select(F.struct(*df.columns)).scalar()


def split_counts(scored: DataFrame) -> DataFrame:
    y = F.col("is_true_threat")
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(y).alias("positives"), F.count_if(~y).alias("negatives"),
        F.count_if("is_benign_burst").alias("benign_bursts"))


def metrics_document(scored: DataFrame, params: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """`scored`: decided sessions of all splits; `params`: alpha, tau_hybrid, tau_ewma;
    `latency`: a latency column `ms` of measured calls, when there is one."""
    test = scored.filter(F.col("split") == "test")
    tau = params.select("tau_hybrid").scalar()
    classes = reports.class_recall(test).join(reports.episode_recall(test), "threat_class")
    auc = reports.auc_table(test, SCORES)
    overall = auc.filter(F.col("group") == "all").select("score", "auc", "n_pos", "n_neg")
    per_class = auc.filter(F.col("group") != "all").groupBy("group").agg(
        *[F.max(F.when(F.col("score") == s, F.col("auc"))).alias(f"auc_{s}") for s in SCORES])
    dataset = F.struct(scored.agg(F.count_distinct("user_id")).scalar().alias("users"),
                       scored.agg(F.count(F.lit(1))).scalar().alias("scoreable_sessions"),
                       keyed(split_counts(scored), "split").alias("per_split"))
    parts = {
        "dataset": dataset, "tuning": single(params),
        "test_flag_level": keyed(reports.flag_level_table(test, tau), "detector"),
        "test_enforcement_bands": keyed(reports.enforcement_rules(test), "rule"),
        "test_auc_overall": keyed(overall, "score"), "auc_by_class": keyed(per_class, "group"),
        "per_class_recall": keyed(classes, "threat_class"), "benign_burst": single(reports.burst_report(test))}
    if latency is not None:
        parts["latency"] = single(reports.latency_summary(latency, "ms"))
    return scored.sparkSession.range(0, 1, 1, 1).select(*[c.alias(n) for n, c in parts.items()])
