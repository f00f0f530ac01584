"""Session scoring: memory-bank similarity, batch encoding, calibration, fusion, decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import scores
from ..session import hash_spread, map_runs
from . import ordering


# --- memory bank -------------------------------------------------------------
CHUNK_ROWS = 20_000


def memory_bank_scores(queries: DataFrame, bank: DataFrame, key: str, vector: str, ids: list[str],
                       k: int = fv.TOPK, chunk_rows: int = CHUNK_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """(ids, key, raw) with raw = 1 - mean of the k largest cosines with the key's bank; 0 for
    an empty bank or a key without one.

    Queries of a key are cut into chunks of about `chunk_rows` and each chunk meets a copy of
    the key's bank, whose size is capped (see `capped_sample`).  A key with a third of all
    queries is thus spread over many tasks, and no (query, bank row) pairs are shuffled.  In a
    sorted partition a chunk's bank comes before its queries, so many small keys share an Arrow batch.

    `keys` holds the queries' keys, row by row, where they can be had without the vectors.
    """
    # at most rows / chunk_rows of the keys
    chunks = F.broadcast((queries if keys is None else keys).groupBy(key)
                         .agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_chunks")).filter(F.col("_chunks") > 1))
    kinds, most = dict(queries.dtypes), F.coalesce("_chunks", F.lit(1))
    pick = F.pmod(F.xxhash64(*ids), most).cast("int")
    own = F.col(vector).cast("array<double>").alias("_v")
    left = queries.join(chunks, key, "left").select(key, pick.alias("_chunk"), F.lit(False).alias("_bank"), *ids, own)
    right = bank.join(chunks, key, "left").select(
        F.col(key).cast(kinds[key]).alias(key), F.explode(F.sequence(F.lit(0), most - 1)).alias("_chunk"), F.lit(True).alias("_bank"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in ids], own)
    rows = hash_spread(left.union(right), key, "_chunk").sortWithinPartitions(key, "_chunk", F.desc("_bank"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, unit = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = _group_starts(batch, (key, "_chunk"), last)
            last = batch.slice(batch.num_rows - 1)
            is_bank = batch["_bank"].to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(np.r_[True, is_bank[1:] != is_bank[:-1]] | begins)
            raw = np.zeros(batch.num_rows)
            for a, b in zip(turns, np.r_[turns[1:], batch.num_rows]):
                if begins[a]:
                    parts, unit = [], None
                if is_bank[a]:
                    parts.append(_unit_rows(batch["_v"].slice(a, b - a)))
                    continue
                unit = np.concatenate(parts) if unit is None and parts else unit
                mine = _unit_rows(batch["_v"].slice(a, b - a))
                if unit is not None:
                    raw[a:b] = bank_distance(mine, unit, k)
            done = batch.select([*ids, key]).append_column("raw", pa.array(raw))
            yield done.filter(pa.array(~is_bank))

    out = ", ".join(f"`{c}` {kinds[c]}" for c in [*ids, key]) + ", raw double"
    return rows.mapInArrow(score, out)


def _group_starts(batch: pa.RecordBatch, columns: tuple, last: pa.RecordBatch | None) -> np.ndarray:
    """Which rows of a sorted batch differ from the row before them, the first one from `last`."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = last is None
    for name in columns:
        now = batch[name] if last is None else pa.concat_arrays([last[name], batch[name]])
        a, b = now.slice(0, len(now) - 1), now.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        differ = pc.or_(differ, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
        out[len(out) - len(differ):] |= differ
    return out


def _unit_rows(vectors: pa.ListArray) -> np.ndarray:
    """The lists of an array as rows of a matrix, scaled to length 1."""
    sizes = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or (sizes != sizes[0]).any():
        raise ValueError("the vectors of a key differ in length, or are missing")
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), sizes[0])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def bank_distance(h: np.ndarray, bank: np.ndarray, k: int) -> np.ndarray:
    if len(bank) == 0:
        return np.zeros(len(h))
    k = min(k, len(bank))
    out = np.empty(len(h))
    for lo in range(0, len(h), 4096):                      # bounds the similarity matrix
        cos = h[lo:lo + 4096] @ bank.T
        out[lo:lo + 4096] = 1.0 - np.partition(cos, -k, axis=1)[:, -k:].mean(axis=1)
    return out


def _per_user_codes(zrows: DataFrame, cap: int, seed: int, weights: dict[str, np.ndarray] | None, use, result: str) -> DataFrame:
    """use(rows, codes, bank positions) per user: the active sessions with a full day of history, their
    encoded windows as unit vectors, and which of them make the bank.

    Only a user's active hours travel (one row per hour, so bounded by the calendar); idle hours are
    filled in and the 24-hour windows are views built inside the task, never shuffled.
    """
    z = [f"z_{i}" for i in range(len(fv.FEATURES))]
    live = zrows.filter("active") if "active" in zrows.columns else zrows
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("user_id").cast("string"), F.col("hour_index").cast("string")))
    rows = live.select("user_id", "hour_index", "in_fit", "idle_z", *z, digest.alias("pick"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        hours = pdf["hour_index"].to_numpy()
        dense = np.zeros((hours[-1] + 1, len(z)))
        dense[:, 0] = pdf["idle_z"].iloc[0]
        dense[hours] = pdf[z].to_numpy(float)
        tail = pdf[hours >= fv.SEQ_LEN - 1]
        if tail.empty:
            return use(tail[["user_id", "hour_index"]], np.zeros((0, 1)), np.zeros(0, int))
        views = np.lib.stride_tricks.sliding_window_view(dense, fv.SEQ_LEN, axis=0).transpose(0, 2, 1)
        h = _encode(views[tail["hour_index"].to_numpy() - fv.SEQ_LEN + 1], weights)
        h = h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-9)
        fit = np.flatnonzero(tail["in_fit"].to_numpy(bool))
        if len(fit) > cap:
            fit = fit[np.argsort(tail["pick"].to_numpy()[fit], kind="stable")[:cap]]
        return use(tail[["user_id", "hour_index"]], h, fit)

    key_type = dict(zrows.dtypes)["user_id"]
    return map_runs(rows, "user_id", "hour_index", score, f"user_id {key_type}, hour_index bigint, {result}")


def session_bank_scores(zrows: DataFrame, k: int = fv.TOPK, cap: int = fv.MEMORY_BANK_CAP,
                        seed: int = 42, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Memory-bank score of every active session with a full day of history.

    Input: `personal_frame` rows.  The bank is the FIT sessions, at most `cap` of them by
    seeded digest.  Windows are encoded by flattening, or by the LSTM whose `weights` are given.
    """
    def rated(rows, codes, bank):
        return rows.assign(raw=bank_distance(codes, codes[bank], k))

    return _per_user_codes(zrows, cap, seed, weights, rated, "raw double")


def bank_codes(zrows: DataFrame, cap: int = fv.MEMORY_BANK_CAP, seed: int = 42,
               weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(user_id, hour_index, code): the banks that `session_bank_scores` compares with, as encoded unit vectors."""
    def picked(rows, codes, bank):
        rows = rows.iloc[bank]
        return rows.assign(code=pd.Series(list(codes[bank]), index=rows.index, dtype=object))

    return _per_user_codes(zrows, cap, seed, weights, picked, "code array<double>")


# --- batch LSTM encoding -------------------------------------------------------
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _encode(windows: np.ndarray, weights: dict[str, np.ndarray] | None) -> np.ndarray:
    """(n, steps, features) -> (n, d): flattened, or the LSTM's last hidden state."""
    if weights is None or len(windows) == 0:
        return windows.reshape(len(windows), -1)
    w_in, w_state = weights["input"].T, weights["state"].T       # gates: in, forget, cell, out
    size = w_state.shape[0]
    h = np.zeros((len(windows), size))
    c = np.zeros_like(h)
    for t in range(windows.shape[1]):
        gates = windows[:, t] @ w_in + h @ w_state + weights["bias"]
        i, f, g, o = (gates[:, n * size:(n + 1) * size] for n in range(4))
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
    return h


def encoder_weights(table: DataFrame) -> dict[str, np.ndarray]:
    """Matrices from a weight table (name, row, values): names input, state, bias.  Its size
    is 4 x hidden rows per matrix, independent of the data."""
    pdf = table.toPandas().sort_values(["name", "row"])
    return {n: (np.stack(g["values"].map(np.asarray).tolist()) if n != "bias" else
                np.asarray(g["values"].iloc[0], dtype=float))
            for n, g in pdf.groupby("name")}


def weight_table(spark, weights: dict[str, np.ndarray]) -> DataFrame:
    """The table that `encoder_weights` reads."""
    rows = [(name, i, [float(x) for x in row]) for name, m in weights.items() for i, row in enumerate(np.atleast_2d(m))]
    return spark.createDataFrame(rows, "name string, row int, values array<double>")


def nested_rows(windows: pa.Array) -> np.ndarray:
    """(n, steps, features) of an Arrow array of lists of lists, all of one shape."""
    if len(windows) == 0:
        return np.zeros((0, fv.SEQ_LEN, 1))
    steps, vectors = np.diff(windows.offsets.to_numpy()), windows.flatten()
    sizes = np.diff(vectors.offsets.to_numpy())
    if windows.null_count or vectors.null_count or (steps != steps[0]).any() or (sizes != sizes[0]).any():
        raise ValueError("windows differ in shape, or are missing")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(windows), steps[0], sizes[0])


def list_rows(m: np.ndarray) -> pa.Array:
    """An Arrow array of lists, or of lists of lists, from a matrix or a stack of them."""
    out = pa.array(np.ascontiguousarray(m, dtype=float).ravel())
    for axis in range(m.ndim - 1, 0, -1):
        out = pa.ListArray.from_arrays(np.arange(0, len(out) + 1, m.shape[axis], dtype=np.int32), out)
    return out


def encode_windows(df: DataFrame, window: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """Adds `encoded`, the LSTM's last hidden state, vectorised over Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def encode(col: pa.Array) -> pa.Array:
        return list_rows(_encode(nested_rows(col), shared.value)) if len(col) else pa.array([], pa.list_(pa.float64()))

    return df.withColumn("encoded", encode(F.col(window)))


# --- calibration, fusion, decisions ---------------------------------------------
def fit_calibrator(calib: DataFrame, raw: str) -> DataFrame:
    """One row (lo, hi): the median and the 99.5 % quantile of the calibration rows."""
    lo, hi = fv.CALIBRATOR_QUANTILES
    q = ordering.quantiles(calib, raw, {"lo": lo, "hi": hi})
    return q.select("lo", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1e-9)
                    .otherwise(F.col("hi")).alias("hi"))


def one_row(params: DataFrame) -> Column:
    """A one-row table as a scalar subquery struct: no join, no collect."""
    return params.select(F.struct(*params.columns)).scalar()


def calibrate_and_fuse(df: DataFrame, cal_a: DataFrame, cal_b: DataFrame, raw_a: str, raw_b: str,
                       alpha) -> DataFrame:
    """Adds a_lstm, a_if and a_hybrid = alpha * a_lstm + (1 - alpha) * a_if."""
    out = df.withColumns({"_ca": one_row(cal_a), "_cb": one_row(cal_b)})
    out = out.withColumns({
        "a_lstm": scores.calibrate(F.col(raw_a), F.col("_ca.lo"), F.col("_ca.hi")),
        "a_if": scores.calibrate(F.col(raw_b), F.col("_cb.lo"), F.col("_cb.hi"))})
    return out.withColumn("a_hybrid", scores.fuse("a_lstm", "a_if", alpha)).drop("_ca", "_cb")


def decide(df: DataFrame, sensitivity: str, tau_ewma, tau_hybrid, beta=fv.SBRS_BETA) -> DataFrame:
    """Flags (EWMA strictly above, hybrid at or above its threshold), risk score, bands,
    actions and correctness."""
    out = df.withColumns({
        "ewma_flag": F.col("ewma_deviation") > scores._c(tau_ewma),
        "hybrid_flag": F.col("a_hybrid") >= scores._c(tau_hybrid),
        "sbrs_value": scores.sbrs(F.col(sensitivity), F.col("a_hybrid"), beta)})
    return out.withColumns({
        "base_action": F.when(F.col("ewma_flag"), "BLOCK").otherwise("PERMIT"),
        "hybrid_action": scores.band_action("sbrs_value"),
        "sbrs_category": scores.band_category("sbrs_value"),
        "ewma_correct": F.col("ewma_flag") == F.col("is_true_threat"),
        "hybrid_correct": F.col("hybrid_flag") == F.col("is_true_threat")})
