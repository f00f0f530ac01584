"""Entity matching and cascade metrics.

Branch outputs do not depend on the OCR threshold, so every branch's predictions are
matched against gold once per document; a threshold then only selects which branch's
counts a document contributes.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import scores, similarity as sim, text as tx
from . import pii

ENTITY_LIST = "array<struct<type:string,value:string>>"


def match_exact(gold: DataFrame, pred: DataFrame, keys: Sequence[str] = ("doc_id",),
                pred_keys: Sequence[str] = (), predictors: Sequence | None = None) -> DataFrame:
    """tp, fp, fn per (keys, pred_keys, type) for one-to-one matching on equal normalised values.

    With equality the greedy assignment is the multiset intersection: both sides are counted
    by value before they meet, so a value repeated millions of times is one row.  With
    `pred_keys`, gold is compared with every one of `predictors` (values or tuples of values of those
    columns); one that predicts nothing misses all gold.  Without the list only predictors that
    have rows are known.
    """
    keys, extra = list(keys), list(pred_keys)
    g = (tx.with_normalised(gold, "value", "_n").groupBy(*keys, "type", "_n")
         .agg(F.count(F.lit(1)).alias("_g")))
    p = (tx.with_normalised(pred, "value", "_n").groupBy(*keys, *extra, "type", "_n")
         .agg(F.count(F.lit(1)).alias("_p")))
    if extra:        # gold is compared with every predictor of the set
        if predictors is None:
            names = pred.select(*extra).distinct().agg(F.collect_set(F.struct(*extra))).scalar()
        else:
            rows = [p if isinstance(p, tuple) else (p,) for p in predictors]
            names = F.array(*[F.struct(*[F.lit(v).cast(pred.schema[c].dataType).alias(c) for c, v in zip(extra, row)])
                              for row in rows])
        g = g.withColumn("_e", F.explode(names)).select("*", "_e.*").drop("_e")
    both = g.join(p, [*keys, *extra, "type", "_n"], "full").fillna(0, ["_g", "_p"])
    tp = F.least("_g", "_p")
    return both.groupBy(*keys, *extra, "type").agg(
        F.sum(tp).alias("tp"), F.sum(F.col("_p") - tp).alias("fp"), F.sum(F.col("_g") - tp).alias("fn"))


def greedy_pairs(gold: list[tuple[str, str]], pred: list[tuple[str, str]], threshold: float) -> list[tuple[int, int, float]]:
    """One-to-one assignment in prediction order; each takes the most similar free gold of its
    type, first on ties.  An equal value is found by lookup; only lengths that can still reach
    the threshold are compared."""
    exact: dict[tuple[str, str], list[int]] = {}
    free: dict[str, dict[int, str]] = {}
    for i, g in enumerate(gold):
        exact.setdefault(g, []).append(i)
        free.setdefault(g[0], {})[i] = g[1]
    pairs = []
    for j, (kind, value) in enumerate(pred):
        pool, best, best_s = free.get(kind, {}), None, 0.0
        same = next((i for i in exact.get((kind, value), ()) if i in pool), None)
        if same is not None:
            best, best_s = same, 1.0
        else:
            for i, other in pool.items():
                if sim.length_bound(other, value) < max(threshold, best_s):
                    continue
                s = sim.normalised_ratio(other, value)
                if s >= threshold and s > best_s:
                    best, best_s = i, s
        if best is not None:
            del pool[best]
            pairs.append((best, j, best_s))
    return pairs


def match_fuzzy(docs: DataFrame, gold: str = "gold", pred: str = "pred", key: str = "doc_id",
                threshold: float = fv.FUZZY_THRESHOLD) -> DataFrame:
    """Greedy matching over two entity arrays of one row; per type tp, fp, fn.

    Both lists arrive in the document's own row, in order, so nothing is shuffled and no
    pairs are emitted.
    """
    key_type = dict(docs.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, g, p in zip(pdf[key], pdf["_g"], pdf["_p"]):
                gl = [(e["type"], tx.fold(e["value"])) for e in g]
                pl = [(e["type"], tx.fold(e["value"])) for e in p]
                matched = greedy_pairs(gl, pl, threshold)
                hit: dict[str, int] = {}
                for _, j, _ in matched:
                    hit[pl[j][0]] = hit.get(pl[j][0], 0) + 1
                for kind in sorted({t for t, _ in gl} | {t for t, _ in pl}):
                    tp = hit.get(kind, 0)
                    rows.append((doc, kind, tp, sum(t == kind for t, _ in pl) - tp,
                                 sum(t == kind for t, _ in gl) - tp))
            yield pd.DataFrame(rows, columns=[key, "type", "tp", "fp", "fn"])

    empty = F.expr(f"cast(array() as {ENTITY_LIST})")
    lists = docs.select(key, F.coalesce(gold, empty).alias("_g"), F.coalesce(pred, empty).alias("_p"))
    return lists.mapInPandas(run, f"{key} {key_type}, type string, tp bigint, fp bigint, fn bigint")


def micro(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summed tp, fp, fn with precision, recall and F1."""
    total = counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f1 = scores.precision_recall("tp", "fp", "fn")
    return total.withColumns({"precision": p, "recall": r, "f1": f1})


def by_category(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """Micro metrics per category and overall (category null), number of documents, and the
    document-weighted recall in the overall row."""
    p, r, f1 = scores.precision_recall("tp", "fp", "fn")
    sums = (counts.groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    sizes = docs.groupBy("category").agg(F.count(F.lit(1)).alias("n_docs"))
    per = (sizes.join(sums, "category", "left").fillna(0, ["tp", "fp", "fn"]).withColumn("_r", r))
    both = per.groupingSets([["category"], []], "category").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_docs")],
        F.sum(F.col("_r") * F.col("n_docs")).alias("_w"))
    weighted = F.when(F.col("category").isNull(), scores.ratio("_w", "n_docs"))
    return both.withColumns({"precision": p, "recall": r, "f1": f1, "weighted_recall": weighted}).drop("_w")


# --- cascade ---------------------------------------------------------------------------
def assemble(docs: DataFrame, branch_rows: DataFrame, tau, key: str = "doc_id") -> DataFrame:
    """The rows (predictions or counts) of the branch each document routes to."""
    routed = docs.withColumn("branch", pii.route(F.col("confidence"), F.col("category"), tau))
    extra = [c for c in branch_rows.columns if c not in (key, "branch")]
    return routed.join(branch_rows, [key, "branch"], "left").select(*routed.columns, *extra)


def tau_sweep(docs: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """F1 at every OCR threshold 0.50 .. 1.00.

    A document switches from branch 2 to branch 3 at one grid point, so documents are
    summed by that point and a threshold is a sum over at most 52 bins.
    """
    first, last = fv.OCR_TAU_STEPS
    wide = counts.groupBy(key).agg(*[
        F.sum(F.when(F.col("branch") == b, F.col(c))).alias(f"{c}_{i}")
        for i, b in enumerate((fv.BRANCH1, fv.BRANCH2, fv.BRANCH3)) for c in ("tp", "fp", "fn")]).fillna(0)
    ranked = docs.join(wide, key, "left").fillna(0, [f"{c}_{i}" for i in range(3) for c in ("tp", "fp", "fn")])
    texty = F.col("category") == "text_extractable"
    reached = F.when(texty, F.lit(0)).otherwise(
        scores.grid_rank("confidence", 100, first, last))
    bins = ranked.groupBy(reached.alias("_n")).agg(*[
        F.sum(F.when(texty if i == 0 else ~texty, F.col(f"{c}_{i}")).otherwise(0)).alias(f"{c}_{i}")
        for i in range(3) for c in ("tp", "fp", "fn")])
    packed = bins.agg(F.collect_list(F.struct("*")).alias("_bins"))
    grid = packed.withColumn("step", F.explode(F.sequence(F.lit(first), F.lit(last))))

    def total(c):
        at = F.col("step") - F.lit(first)
        return F.aggregate("_bins", F.lit(0).cast("bigint"), lambda s, b: s + b[f"{c}_0"] + F.when(
            b["_n"] > at, b[f"{c}_1"]).otherwise(b[f"{c}_2"]))

    out = grid.select("step", (F.col("step") / 100.0).alias("tau"), *[total(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f1 = scores.precision_recall("tp", "fp", "fn")
    return out.withColumns({"precision": p, "recall": r, "f1": f1})


def best_tau(sweep: DataFrame, default: float = fv.OCR_TAU) -> DataFrame:
    from .tuning import first_best
    return first_best(sweep, ["tau", "f1"], [-F.col("f1"), F.col("step")], {"tau": default, "f1": -1.0})


def routed_counts(docs: DataFrame, tau) -> DataFrame:
    """Documents per category and branch."""
    branches = (fv.BRANCH1, fv.BRANCH2, fv.BRANCH3)
    routed = docs.withColumn("branch", pii.route(F.col("confidence"), F.col("category"), tau))
    return (routed.groupBy("category").pivot("branch", list(branches)).agg(F.count(F.lit(1))).fillna(0)
            .select("category", *[F.col(f"`{b}`").alias(f"branch{i}") for i, b in enumerate(branches, 1)]))


def corpus_counts(docs: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents, gold entities and documents without any, per category."""
    sizes = gold.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return docs.join(sizes, key, "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("_n"), F.lit(0)).alias("gold_entities"),
        F.count_if(F.col("_n").isNull()).alias("pii_free_docs"))


def status_coverage(calls: DataFrame) -> DataFrame:
    """Images and successful replies per category."""
    return calls.groupBy("category").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("status").startswith("ok")).alias("scored"))


def cost_report(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Billed and cached calls, billed tokens and cost at the price per million tokens."""
    used = F.col("billed_now") & F.col("prompt_tokens").isNotNull()
    total = calls.groupBy("model").agg(
        F.count_if(used).alias("calls_billed"),
        F.count_if(~F.col("billed_now") & F.col("status").startswith("ok")).alias("calls_from_cache"),
        F.coalesce(F.sum(F.when(used, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(used, F.col("completion_tokens"))), F.lit(0)).alias("completion_tokens"))
    priced = total.join(prices, "model", "left")
    return priced.withColumn("cost", F.col("prompt_tokens") / 1e6 * F.col("input_per_m")
                             + F.col("completion_tokens") / 1e6 * F.col("output_per_m"))


def pending_calls(images: DataFrame, cache: DataFrame, order: str, budget: int, key: str = "doc_id") -> DataFrame:
    """Images without a successful cached reply, in call order, up to the call budget."""
    done = cache.filter(F.col("status").startswith("ok")).select(key).distinct()
    return images.join(done, key, "left_anti").orderBy(order).limit(budget)


def coverage_table(cascade: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline against cascade recall per category and document-weighted overall, 3 dp."""
    def recall(df, name):
        return df.select(F.coalesce("category", F.lit("overall_weighted")).alias("category"),
                         scores.round_even(F.coalesce("weighted_recall", "recall"), 3).alias(name))
    both = recall(baseline, "base").join(recall(cascade, "cascade"), "category")
    return both.withColumn("gain", scores.round_even(F.col("cascade") - F.col("base"), 3))


def coverage_long(table: DataFrame) -> DataFrame:
    return table.filter(F.col("category") != "overall_weighted").unpivot(
        "category", ["base", "cascade"], "system", "coverage")
