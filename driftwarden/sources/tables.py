"""Sources and sinks: delimited tables, nested documents, metrics, model tables, caches."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..session import stage_observed
from . import json_parts, layouts

# File names per table, measured file first, simulated file as fallback.  Pass your own
# mapping to read differently named files.
FILES = {
    "pii_scans": ("pii_scan_results_v2_real.csv", "pii_scan_results.csv"),
    "anomaly_comparison": ("anomaly_detection_comparison_v2_real.csv", "anomaly_detection_comparison.csv"),
    "ewma_baselines": ("ewma_user_baselines.csv",),
    "blocked_audit": ("blocked_events_audit.csv",),
    "events": ("events.json",),
    "system_log": ("system.log",),
}
LAYOUTS = {"pii_scans": fv.PII_SCAN_COLUMNS, "anomaly_comparison": fv.COMPARISON_COLUMNS,
           "ewma_baselines": fv.BASELINE_COLUMNS, "blocked_audit": fv.BLOCKED_AUDIT_COLUMNS,
           "scored_sessions": fv.COMPARISON_COLUMNS + fv.SCORED_EXTRA_COLUMNS,
           "sessions": fv.SESSION_COLUMNS}


class EngineUnavailable(RuntimeError):
    """A model table is missing."""


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def resolve(spark: SparkSession, root: str, key: str, files: Mapping[str, Sequence[str]] = FILES) -> str:
    """First existing candidate of a table; a clear error when there is none."""
    for name in files[key]:
        if exists(spark, f"{root}/{name}"):
            return f"{root}/{name}"
    raise FileNotFoundError(f"no file for '{key}' in {root}; expected one of {list(files[key])}")


# --- delimited tables ------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, layout: Sequence[tuple[str, str]]) -> DataFrame:
    """Delimited text with a header, read as text and coerced; bad values become null."""
    schema = ", ".join(f"`{c}` string" for c, _ in layout)
    raw = spark.read.schema(schema).options(header=True, encoding="UTF-8", escape='"').csv(path)     # doubled quotes
    parse = {"timestamp": tx.parse_timestamp, "boolean": tx.parse_bool,
             "double": tx.parse_number, "bigint": lambda c: tx.parse_number(c, "bigint")}
    return raw.select(*[parse.get(t, lambda c: c)(F.col(f"`{c}`")).alias(c) for c, t in layout])


def load(spark: SparkSession, root: str, key: str, files: Mapping[str, Sequence[str]] = FILES) -> DataFrame:
    return read_table(spark, resolve(spark, root, key, files), LAYOUTS[key])


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session grid; empty or NaN labels are null."""
    df = read_table(spark, path, fv.SESSION_COLUMNS)
    return df.withColumns({c: F.when(~F.lower(F.trim(c)).isin("", "nan", "none"), F.col(c))
                           for c in ("threat_class", "episode_id")})


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_table(df: DataFrame, path: str, layout: Sequence[tuple[str, str]], delimited: bool = True) -> None:
    """Columns in the layout's order; timestamps as text when delimited."""
    if not delimited:
        df.select(*[c for c, _ in layout]).write.parquet(path)
        return
    cols = [(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if dict(df.dtypes)[c].startswith("timestamp")
             else F.col(c)) for c, _ in layout]
    df.select(*cols).write.options(header=True, escape='"').csv(path)


def rewrite(spark: SparkSession, path: str, layout: Sequence[tuple[str, str]], change) -> str:
    """Read a stored table, recompute columns, write a new version next to it."""
    out = f"{path.rstrip('/')}.v-{uuid.uuid4().hex[:12]}"
    write_table(change(read_table(spark, path, layout)), out, layout)
    return out


# --- nested documents --------------------------------------------------------------------
def parsed(parts: DataFrame, key: str, schema: str) -> DataFrame:
    """The parts under a top-level key as rows; those that are no valid JSON are left out."""
    rows = parts.filter(F.col("key") == key).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"), "value")
    return rows.filter(F.to_json("e").isNotNull() & (F.try_parse_json("value").isNotNull())).select("e.*")


def read_events_document(spark: SparkSession, path: str, range_bytes: int = json_parts.RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(events, metadata) of JSON documents holding both top-level keys; a document of any size is read by many tasks."""
    ranges, keys = json_parts.whole_documents(spark, path, range_bytes)
    if not any({"log_metadata", "events"} <= found for found in keys.values()):
        raise ValueError("events document lacks 'log_metadata' or 'events'")
    events = json_parts.parts_of(spark, ranges, items=["events"], range_bytes=range_bytes)
    metadata = json_parts.parts_of(spark, ranges, values=["log_metadata"], range_bytes=range_bytes)     # the events' text is not read for it
    return parsed(events, "events", f"struct<{layouts.EVENT_FIELDS}>"), parsed(metadata, "log_metadata", layouts.METADATA)


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same events stored one per line, which splits over many tasks."""
    return spark.read.schema(layouts.EVENT).json(path)


def parse_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Ad-hoc JSON event payloads, one per row, in the event layout."""
    fields = f"struct<{layouts.EVENT_FIELDS}>"
    return payloads.select(F.from_json(column, fields).alias("e")).select("e.*")


def read_ground_truth(spark: SparkSession, path: str, range_bytes: int = json_parts.RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(text documents, image documents) with nested gold entities."""
    docs = parsed(json_parts.json_parts(spark, path, ["documents"], (), range_bytes)[0], "documents", layouts.TRUTH)
    is_text = F.col("category") == "text_extractable"
    return docs.filter(is_text), docs.filter(~is_text)


def load_all(spark: SparkSession, root: str, files: Mapping[str, Sequence[str]] = FILES,
             with_counts: bool = True) -> dict[str, DataFrame]:
    """Every stored table, parsed once into a columnar stage table and known as a temp view, plus a table of row counts.

    The counts are observed by the jobs that write the stage tables.
    """
    tables = {k: load(spark, root, k, files) for k in ("pii_scans", "anomaly_comparison", "ewma_baselines", "blocked_audit")}
    events, metadata = read_events_document(spark, resolve(spark, root, "events", files))
    tables |= {"events": events, "log_metadata": metadata,
               "system_log": read_log(spark, resolve(spark, root, "system_log", files))}
    counts = []
    for name, df in tables.items():
        tables[name], seen = stage_observed(df, name, {"rows": F.count(F.lit(1))})
        tables[name].createOrReplaceTempView(name)
        counts.append((name, seen["rows"]))
    if with_counts:
        tables["row_counts"] = spark.createDataFrame(counts, "table string, rows long")
    return tables


# --- metrics -----------------------------------------------------------------------------
METRIC_PATHS, PII_METRIC_PATHS = fv.METRIC_PATHS, fv.PII_METRIC_PATHS
COUNTED = ("users", "test_sessions", "test_positives", "gold_entities")


def read_metrics(spark: SparkSession, path: str, paths: Mapping[str, str] = METRIC_PATHS) -> DataFrame:
    """Typed record out of nested metric documents; no row when a document is missing,
    malformed or lacks a required field."""
    kinds = ["bigint" if n in COUNTED else "string" if n == "model" else "double" for n in paths]
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in zip(paths, kinds)))
    raw = spark.read.text(path, wholetext=True)
    fields = [F.get_json_object("value", "$" + (p if p.startswith("[") else "." + p)).try_cast(k).alias(n)
              for (n, p), k in zip(paths.items(), kinds)]
    return raw.select(*fields).na.drop("any")


def write_metrics(parts: Mapping[str, DataFrame], path: str) -> None:
    """Nested metric document: one array of rows per part, each part a small report."""
    spark = next(iter(parts.values())).sparkSession
    doc = spark.range(0, 1, 1, 1).select(*[
        df.agg(F.collect_list(F.struct(*df.columns))).scalar().alias(name) for name, df in parts.items()])
    doc.write.json(path)


# --- model tables ---------------------------------------------------------------------------
MODEL_TABLES = ("user_stats", "scaler", "banks", "forest", "calibrators", "params")
ENCODER_TABLES = ("codes", "encoder")       # banks as encoded windows, the encoder's weights; a model may have none


def save_model(tables: Mapping[str, DataFrame], path: str) -> None:
    for name in (*MODEL_TABLES, *(n for n in ENCODER_TABLES if n in tables)):
        tables[name].write.parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    missing = [n for n in MODEL_TABLES if not exists(spark, f"{path}/{n}")]
    if missing:
        raise EngineUnavailable(f"model tables {missing} not found in {path}; train the engine first")
    found = [n for n in ENCODER_TABLES if exists(spark, f"{path}/{n}")]
    return {n: spark.read.parquet(f"{path}/{n}") for n in (*MODEL_TABLES, *found)}


def default_params(spark: SparkSession, path: str) -> DataFrame:
    """Stored parameters, or the fallback weights when no model was trained."""
    try:
        return load_model(spark, path)["params"]
    except EngineUnavailable:
        return spark.range(1).select(F.lit(fv.FALLBACK_ALPHA).alias("alpha"),
                                     F.lit(fv.HYBRID_FLAG_THRESHOLD).alias("tau_hybrid"),
                                     F.lit(fv.LEGACY_EWMA_TAU).alias("tau_ewma"))


# --- prediction cache ------------------------------------------------------------------------
def cache_keys(files: DataFrame, doc_id: str, model: str) -> DataFrame:
    """Key of a document's cached reply: document, model slug and first 12 digits of the
    content digest.  `files` has a binary `content` column (binaryFile source)."""
    digest = F.substring(F.sha1("content"), 1, 12)
    return files.select(doc_id, F.concat_ws("-", F.col(doc_id).cast("string"), tx.slug(F.lit(model)), digest).alias("cache_key"))


def cache_hits(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents whose key holds a successful reply; failures are retried."""
    good = cache.filter(F.col("status").startswith("ok")).select("cache_key")
    return keys.join(good, "cache_key", "left_semi")
