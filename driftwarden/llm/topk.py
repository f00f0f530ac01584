"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector.  Scores are integers within a known bound; a histogram
of all scores per query, summed over the cluster, shows which bin holds the k-th largest, and the next
round cuts that bin into finer ones until it is a single score.  Then everything above it is kept, and of
the vectors that score exactly it the smallest ids fill the places left.

Candidates are packed into blocks of rows, queries into blocks of `QUERIES`; a block of queries meets a
block of candidates in one matrix product.  What leaves a task is a sparse histogram, or at
most k rows per query and block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window, functions as F

from driftwarden.session import stage_table

BINS = 256
QUERIES = 1024
ROWS = 4096


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, vec (floor(scale * component), long) of the rows that take part."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    # a sum of x - x is 0 just if every x is finite; a null component makes it null
    sound = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + (x - x)) == 0
    return (kept.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & sound)
            .select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("vec")))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` rows of one length: block, dims, ids and values (little-endian int64)."""
    def run(batches):
        for pdf in batches:
            lengths = pdf["vec"].map(len)
            for dims, part in pdf.groupby(lengths):
                for i in range(0, len(part), size):
                    cut = part.iloc[i:i + size]
                    yield pd.DataFrame({"dims": [dims], "ids": [cut["vec_id"].to_numpy(np.int64).tobytes()],
                                        "vals": [np.array(cut["vec"].tolist(), np.int64).reshape(len(cut), dims).tobytes()]})
    return (rows.mapInPandas(run, "dims int, ids binary, vals binary")
            .withColumn("block", F.monotonically_increasing_id()))


def _scores(queries: bytes, values: bytes, dims: int) -> np.ndarray:
    a = np.frombuffer(queries, np.int64).reshape(-1, dims) if dims else np.zeros((0, 0), np.int64)
    b = np.frombuffer(values, np.int64).reshape(-1, dims) if dims else np.zeros((0, 0), np.int64)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dims, 1)
    if bound < 2 ** 53:         # exact in doubles
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` (vec_id, vec: array<long>) with the largest inner product
    for each row of `queries` (same columns), the row with the query's own id left out.

    Ties go to the smaller vec_id; with fewer rows than k, all are returned.  Vectors of another length than the
    query's are not compared.  A query or vector that is listed twice counts twice; an empty
    table gives no rows.  Scores must fit a long.
    """
    base = stage_table(packed(vectors, ROWS), "candidates")
    asked = stage_table(packed(queries, QUERIES).select(
        "dims", F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vals").alias("qvals")), "queries")

    def largest(batches):
        for pdf in batches:
            yield pd.DataFrame({"dims": pdf["dims"], "most": [
                int(np.abs(np.frombuffer(v, np.int64)).max(initial=0)) for v in pdf["vals"]]})

    peaks = (base.select("dims", "vals").mapInPandas(largest, "dims int, most long")
             .groupBy("dims").agg(F.max("most").alias("base_most")))
    own = (asked.select("dims", F.col("qvals").alias("vals")).mapInPandas(largest, "dims int, most long")
           .groupBy("dims").agg(F.max("most").alias("most")))
    span = peaks.join(own, "dims").agg(F.max(F.expr("dims * base_most * most"))).first()[0]
    if span is None:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = 1
    while width * BINS <= 2 * int(span):
        width *= BINS
    pairs = base.join(asked, "dims")

    # per query block: the lower edge of every query's open bin
    def start(batches):
        for pdf in batches:
            yield pd.DataFrame({"qblock": pdf["qblock"], "low": [
                np.full(len(q) // 8, -int(span), np.int64) for q in pdf["qids"]]})

    state = asked.select("qblock", "qids").mapInPandas(start, "qblock long, low array<long>")
    while True:
        def histogram(batches, width=width):
            for pdf in batches:
                for dims, ids, vals, qblock, qids, qvals, low in zip(*(pdf[c] for c in (
                        "dims", "ids", "vals", "qblock", "qids", "qvals", "low"))):
                    own_, other = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                    scores = _scores(qvals, vals, dims)
                    bin_ = (scores - np.asarray(low, np.int64)[:, None]) // width
                    at = (bin_ >= 0) & (own_[:, None] != other[None, :])
                    rows = np.broadcast_to(np.arange(len(own_))[:, None], at.shape)[at]
                    code, n = np.unique(rows * (BINS + 1) + np.minimum(bin_[at], BINS), return_counts=True)
                    # bins below the one with this block's own k-th largest can't hold the k-th of all
                    above = np.cumsum(n[::-1])[::-1]
                    ends = np.searchsorted(code // (BINS + 1), code // (BINS + 1), "right")
                    beyond = above - np.append(above, 0)[ends] - n
                    keep = beyond < k
                    yield pd.DataFrame({"qblock": qblock, "q": (code[keep] // (BINS + 1)).astype(np.int32),
                                        "bin": (code[keep] % (BINS + 1)).astype(np.int32), "n": n[keep]})

        counts = (pairs.join(state, "qblock").select("dims", "ids", "vals", "qblock", "qids", "qvals", "low")
                  .mapInPandas(histogram, "qblock long, q int, bin int, n long")
                  .groupBy("qblock", "q", "bin").agg(F.sum("n").alias("n")))
        order = Window.partitionBy("qblock", "q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("above", F.coalesce(F.sum("n").over(order), F.lit(0)))
        # the bin that holds the k-th largest, or the lowest if there are fewer
        picked = (counts.filter(F.col("above") < k).groupBy("qblock", "q")
                  .agg(F.min(F.struct("bin", "above")).alias("p"))
                  .groupBy("qblock").agg(F.map_from_entries(F.collect_list(F.struct("q", F.col("p.bin").alias("bin")))).alias("bins")))
        low = F.transform("low", lambda x, i: x + F.coalesce(F.element_at("bins", i.cast("int")), F.lit(0)) * width)
        state = stage_table(state.join(picked, "qblock", "left").select("qblock", low.alias("low")), "bounds")
        if width == 1:
            break
        width //= BINS

    def pick(batches):
        for pdf in batches:
            for dims, ids, vals, qblock, qids, qvals, low in zip(*(pdf[c] for c in (
                    "dims", "ids", "vals", "qblock", "qids", "qvals", "low"))):
                own_, other = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                scores = _scores(qvals, vals, dims)
                hit = (scores >= np.asarray(low, np.int64)[:, None]) & (own_[:, None] != other[None, :])
                q, c = np.nonzero(hit)
                value = scores[q, c]
                order = np.lexsort((other[c], -value, q))
                q, c, value = q[order], c[order], value[order]
                place = np.arange(len(q)) - np.searchsorted(q, q, "left")
                best = place < k
                yield pd.DataFrame({"qblock": qblock, "q": q[best].astype(np.int32), "query_id": own_[q[best]],
                                    "vec_id": other[c[best]], "score": value[best]})

    found = (pairs.join(state, "qblock").select("dims", "ids", "vals", "qblock", "qids", "qvals", "low")
             .mapInPandas(pick, "qblock long, q int, query_id long, vec_id long, score long"))
    best = Window.partitionBy("qblock", "q", "part").orderBy(F.desc("score"), "vec_id")
    thinned = (found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
               .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
    last = Window.partitionBy("qblock", "q").orderBy(F.desc("score"), "vec_id")
    return (thinned.withColumn("rank", F.row_number().over(last).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search_embeddings(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """top_k of the rows whose vec_id is divisible by `every`, against all rows."""
    rows = quantised(vectors)
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)
