"""Evaluation of the three-branch cascade at a given and at the calibrated OCR threshold.

Predictions are matched once per document and branch; every table below selects from those
counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..operators import matching, ordering, pii
from ..session import cut_lineage


def calibrated_tau(docs: DataFrame, counts: DataFrame, fraction: float = fv.CALIB_FRACTION, seed: int = 1337) -> DataFrame:
    """Best threshold (tau, f1) on a stratified sample of the images."""
    images = docs.filter(F.col("category") != "text_extractable")
    calib = ordering.stratified_sample(images, "doc_id", "category", fraction, seed)
    sweep = matching.tau_sweep(docs.join(calib.select("doc_id"), "doc_id", "left_semi"), counts)
    return matching.best_tau(sweep)


def tables_at(docs: DataFrame, counts: DataFrame, tau: float | Column) -> dict[str, DataFrame]:
    """All-documents and executed-only metrics of the cascade at one threshold."""
    picked = matching.assemble(docs, counts, tau)
    routed = docs.withColumn("branch", pii.route(F.col("confidence"), F.col("category"), tau))
    ran = pii.executed(F.col("branch"), F.col("status"))
    known = F.col("type").isNotNull()
    return {
        "by_category": matching.by_category(picked, docs), "overall": matching.micro(picked),
        "by_type": matching.micro(picked.filter(known), ["type"]),
        "routed": matching.routed_counts(docs, tau),
        "executed_by_category": matching.by_category(picked.filter(ran), routed.filter(ran)),
        "executed_by_type": matching.micro(picked.filter(ran & known), ["type"]),
        "not_executed": routed.agg(F.count_if(~ran).alias("n_not_executed"))}


def evaluate(docs: DataFrame, counts: DataFrame, tau: float = fv.OCR_TAU) -> dict[str, DataFrame]:
    """Tables at both thresholds, the text-only baseline, the head-to-head on answered images and
    the counterfactual on confident ones.

    `docs`: doc_id, category, confidence, status; `counts`: per (doc_id, branch, type) tp, fp,
    fn for all branches, from `match_exact` or per-branch `match_fuzzy`.
    """
    best = cut_lineage(calibrated_tau(docs, counts))
    out = {f"given.{k}": v for k, v in tables_at(docs, counts, tau).items()}
    out |= {f"calibrated.{k}": v for k, v in tables_at(docs, counts, best.select("tau").scalar()).items()}
    text_only = docs.join(counts.filter(F.col("branch") == fv.BRANCH1).drop("branch"), "doc_id")
    answered = docs.filter(F.col("status").startswith("ok"))
    engines = counts.filter(F.col("branch") != fv.BRANCH1)

    def seen(rows, by):
        return matching.micro(engines.join(rows.select("doc_id"), "doc_id", "left_semi"), by)

    return out | {
        "calibration": best, "baseline.by_category": matching.by_category(text_only, docs),
        "coverage": matching.coverage_table(out["given.by_category"], matching.by_category(text_only, docs)),
        "head_to_head": seen(answered, ["branch"]), "head_to_head.by_type": seen(answered, ["branch", "type"]),
        "confident": seen(answered.filter(F.col("confidence") >= tau), ["branch"])}
