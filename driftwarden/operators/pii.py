"""Personal-data scan of documents: recognisers, overlap suppression, roll-up, scan rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as fv
from ..functions import scores, text as tx


def recognise(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[tx.Rule] = tx.RULES,
              min_score: float = fv.MIN_RULE_SCORE) -> DataFrame:
    """One row per rule hit over the whole text: recogniser, start, end, score, value.

    A pure projection: the text is read once where it lies and only hits leave the task.
    """
    hits = F.flatten(F.array(*[tx.rule_hits(F.col(text), r) for r in rules]))
    kept = F.filter(hits, lambda h: h["score"] >= min_score)
    return docs.select(key, F.inline(kept))


def suppress_overlaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keep the best span and drop those overlapping a kept one (score desc, start asc).

    Spans are first cut into chains that overlap; different chains cannot affect each other,
    so the greedy choice runs inside one short chain and never over a whole document.
    """
    by_start = Window.partitionBy(key).orderBy("start", "end", "recogniser")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    chained = (spans.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
               .withColumn("_chain", F.sum("_new").over(by_start)))
    fields = [c for c in spans.columns if c != key]
    item = F.struct((-F.col("score")).alias("_rank"), F.col("start").alias("_at"), *fields)
    chains = chained.groupBy(key, "_chain").agg(F.array_sort(F.collect_list(item)).alias("_items"))

    def choose(kept, span):
        clash = F.exists(kept, lambda k: (span["start"] < k["end"]) & (k["start"] < span["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(span)))

    none = F.slice(F.col("_items"), 1, 0)
    best = chains.select(key, F.inline(F.aggregate("_items", none, choose)))
    return best.select(key, *fields)


def entities(spans: DataFrame) -> DataFrame:
    """Spans -> (key, type, value) with internal type names and trimmed values."""
    return spans.withColumn("type", scores.lookup("recogniser", fv.RECOGNISER_TYPES)).filter(
        F.col("type").isNotNull()).withColumn("value", F.trim("value")).drop("recogniser", "score")


def tier_counts(types: DataFrame, key: str = "doc_id") -> DataFrame:
    """HIGH / MEDIUM / LOW entity counts per document."""
    tier = scores.lookup("type", fv.ENTITY_TIER)
    return types.groupBy(key).agg(*[F.count_if(tier == t).alias(f"{t.lower()}_entities")
                                    for t in fv.ENTITY_WEIGHTS])


def tier_counts_of(list_col: Column) -> dict[str, Column]:
    """The same counts from an array of {type, value}."""
    def n(t):
        names = [k for k, v in fv.ENTITY_TIER.items() if v == t]
        return F.size(F.filter(F.coalesce(list_col, F.array()), lambda e: e["type"].isin(*names)))
    return {f"{t.lower()}_entities": n(t) for t in fv.ENTITY_WEIGHTS}


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   rules: Sequence[tx.Rule] = tx.RULES) -> DataFrame:
    """Document key, tier counts, sensitivity, category and action of every document, with
    zero counts for clean ones."""
    found = entities(suppress_overlaps(recognise(docs, key, text, rules), key))
    counts = docs.select(key).join(tier_counts(found, key), key, "left").fillna(0)
    s = scores.sensitivity("high_entities", "medium_entities", "low_entities")
    return (counts.withColumn("sensitivity_score", s)
            .withColumn("risk_category", scores.risk_category("sensitivity_score"))
            .withColumn("action_taken", scores.action_for("risk_category")))


# --- routing -------------------------------------------------------------------------
def serving_branch(file_type: Column, confidence: Column) -> Column:
    """Text types by substring or extension; unknown confidence goes to OCR."""
    kind = F.lower(F.coalesce(file_type, F.lit("")))
    texty = kind.contains("text") | kind.isin(*fv.TEXT_EXTENSIONS)
    return (F.when(texty, fv.BRANCH1).when(confidence.isNull() | (confidence >= fv.OCR_TAU), fv.SERVING_BRANCH2)
            .otherwise(fv.SERVING_BRANCH3))


def route(confidence: Column, category: Column, tau) -> Column:
    """Text to branch 1; images by OCR confidence, unknown confidence to branch 3."""
    return (F.when(category == "text_extractable", fv.BRANCH1)
            .when(confidence >= scores._c(tau), fv.BRANCH2).otherwise(fv.BRANCH3))


def executed(branch: Column, status: Column) -> Column:
    """A branch-3 document counts as executed only with a successful reply."""
    return (branch != fv.BRANCH3) | F.coalesce(status.startswith("ok"), F.lit(False))


def ocr_rollup(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Transcript lines in box order, character-weighted confidence and box count."""
    chars = F.length("text")
    lines = F.array_sort(F.collect_list(F.struct("box_no", "text")))
    return boxes.groupBy(key).agg(
        F.array_join(F.transform(lines, lambda b: b["text"]), "\n").alias("transcript"),
        (F.sum(chars * F.col("confidence")) / F.greatest(F.sum(chars), F.lit(1))).alias("confidence"),
        F.count(F.lit(1)).alias("boxes"))


# --- stored scan rows ------------------------------------------------------------------
def scan_rows(routed: DataFrame) -> DataFrame:
    """Rows in the stored scan layout from one routed row per document.

    Needs position, document fields, branch, confidence, the routed branch's entities,
    branch-1 entities, and branch latencies (branch 3 pays OCR plus model).
    """
    counts = tier_counts_of(F.col("entities"))
    base = tier_counts_of(F.col("text_entities"))
    ms = (F.when(F.col("branch") == fv.BRANCH1, F.col("b1_ms")).when(F.col("branch") == fv.BRANCH2, F.col("b2_ms"))
          .otherwise(F.col("b2_ms") + F.col("b3_ms")))
    rows = routed.withColumns(counts)
    rows = rows.withColumns({
        "sensitivity_score": scores.sensitivity("high_entities", "medium_entities", "low_entities"),
        "base_system_score": scores.sensitivity(*base.values())})
    rows = rows.withColumn("risk_category", scores.risk_category("sensitivity_score"))
    return rows.withColumns({
        "scan_id": F.format_string("PII-%04d", "position"), "branch_used": F.col("branch"),
        "file_type": scores.lookup("category", fv.CATEGORY_FILE_TYPE),
        "ocr_confidence": F.coalesce(scores.round_even("confidence", 2).cast("string"), F.lit("N/A")),
        "base_system_label": F.when(F.col("category") == "text_extractable",
                                    scores.risk_category("base_system_score")).otherwise(fv.BLIND_LABEL),
        "processing_ms": scores.round_even(ms, 1), "action_taken": scores.action_for("risk_category"),
        "slack_alert_sent": F.col("risk_category").isin("HIGH-RISK", "SENSITIVE"),
        "jira_ticket_created": F.col("risk_category") == "HIGH-RISK",
    }).select(*[c for c, _ in fv.PII_SCAN_COLUMNS])
