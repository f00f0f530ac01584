"""Stored layouts: the given tables are written as delimited text, JSON or model tables, bad values included, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from driftwarden import fixed_values as fv
from driftwarden.session import shared_dir
from driftwarden.sources import tables
from registry import Book, event_docs, fixtures as fx

book = Book()
query = book.query
CHUNK = 500             # events or documents in one JSON document


def folder(spark) -> str:
    return f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"


def in_layout(df: DataFrame, layout, **given: Column) -> DataFrame:
    """Every column of a layout as text: the given ones, else the column's own name."""
    return df.select(*[given.get(c, F.lit(c)).cast("string").alias(c) for c, _ in layout])


def result(df: DataFrame) -> DataFrame:
    """Instants as the zone-less times that were written."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def outcome(layout, **given: str) -> str:
    """The select list of a layout: given expressions, else the column's own name as text."""
    return ", ".join(f"{given[c]} AS \"{c}\"" if c in given else f"'{c}' AS \"{c}\"" for c, _ in layout)


# --- delimited tables ---------------------------------------------------------------------
STAMP = "CAST('2026-04-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || ' 08:05:00' AS TIMESTAMP)"
SCAN_NUMBERS = ("medium_entities", "low_entities", "sensitivity_score", "base_system_score")


def stamp(ok: Column) -> Column:
    written = F.concat(F.lit("2026-04-"), F.lpad((1 + F.col("doc_id") % 28).cast("string"), 2, "0"), F.lit(" 08:05:00"))
    return F.when(ok, written).otherwise("not a time")


@query("stored_scans", "SELECT " + outcome(
    fv.PII_SCAN_COLUMNS, scan_id="printf('PII-%04d', doc_id)", timestamp=f"CASE WHEN doc_id % 5 <> 0 THEN {STAMP} END",
    user_id="source", file_name="'a, \"' || lang || '\".pdf'", ocr_confidence="CASE WHEN doc_id % 3 <> 0 THEN doc_id % 100 / 1e2 END",
    high_entities="CASE WHEN doc_id % 7 > 1 THEN n_chars END", processing_ms="CASE WHEN doc_id % 2 = 0 THEN n_chars / 8e0 END",
    slack_alert_sent="CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END",
    jira_ticket_created="CASE doc_id % 4 WHEN 3 THEN true END", **{c: "doc_id % 30" for c in SCAN_NUMBERS}) + " FROM documents")
def stored_scans(spark, sf_dir):
    """The measured file is read and the fallback passed over; bad values are null, quotes and commas survive."""
    d, root = fx.table(spark, sf_dir, "documents"), folder(spark)
    i = F.col("doc_id")
    rows = in_layout(
        d, fv.PII_SCAN_COLUMNS, scan_id=F.format_string("PII-%04d", i), timestamp=stamp(i % 5 != 0), user_id=F.col("source"),
        file_name=F.concat(F.lit('a, "'), "lang", F.lit('".pdf')),
        ocr_confidence=F.when(i % 3 == 0, F.lit("N/A")).otherwise((i % 100 / 100.0).cast("string")),
        high_entities=F.when(i % 7 == 0, F.lit("x")).when(i % 7 > 1, F.col("n_chars").cast("string")),
        processing_ms=F.when(i % 2 == 0, (F.col("n_chars") / 8.0).cast("string")).otherwise("oops"),
        slack_alert_sent=F.element_at(F.array(*map(F.lit, ("True", "FALSE", " true", "maybe"))), (i % 4 + 1).cast("int")),
        jira_ticket_created=F.element_at(F.array(*map(F.lit, ("1", "yes", "", "TRUE"))), (i % 4 + 1).cast("int")),
        **{c: i % 30 for c in SCAN_NUMBERS})
    measured, simulated = tables.FILES["pii_scans"]
    tables.write_table(rows, f"{root}/{measured}", fv.PII_SCAN_COLUMNS)
    tables.write_table(rows.withColumn("scan_id", F.lit("fallback")), f"{root}/{simulated}", fv.PII_SCAN_COLUMNS)
    return result(tables.load(spark, root, "pii_scans"))


COMPARED = {"bigint": "k", "double": "value / 4", "boolean": "k % 2 = 0"}


@query("stored_comparison", fx.sql("SELECT " + outcome(
    fv.COMPARISON_COLUMNS, **{c: COMPARED[t] for c, t in fv.COMPARISON_COLUMNS if t in COMPARED},
    event_id="CAST(event_id AS VARCHAR)", user_id="CAST(user_id AS VARCHAR)", timestamp="date_trunc('second', ts)",
    file_accessed="CASE WHEN k % 3 = 0 THEN NULL ELSE event_type || ' — ' || k END") + " FROM act", "act"))
def stored_comparison(spark, sf_dir):
    """Only the simulated file exists."""
    a, root = fx.activity(spark, sf_dir), folder(spark)
    k = F.col("k")
    of = {"bigint": k, "double": F.col("value") / 4, "boolean": F.initcap((k % 2 == 0).cast("string"))}
    rows = in_layout(a, fv.COMPARISON_COLUMNS, **{
        **{c: of[t] for c, t in fv.COMPARISON_COLUMNS if t in of}, "event_id": F.col("event_id"), "user_id": F.col("user_id"),
        "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "file_accessed": F.when(k % 3 != 0, F.concat("event_type", F.lit(" — "), k.cast("string")))})
    tables.write_table(rows, f"{root}/{tables.FILES['anomaly_comparison'][-1]}", fv.COMPARISON_COLUMNS)
    return result(tables.load(spark, root, "anomaly_comparison"))


@query("stored_baselines", "SELECT " + outcome(
    fv.BASELINE_COLUMNS, user_id="c_name", user_name="'n, ' || c_custkey", department="c_mktsegment",
    **{"lambda": "3e-1", "baseline_ewma": "CAST(c_acctbal AS DOUBLE)", "current_ewma": "CASE WHEN c_custkey % 3 > 0 THEN c_custkey / 8e0 END",
       "deviation_ratio": "CAST(NULL AS DOUBLE)", "anomaly_threshold": "2e0", "last_updated": "TIMESTAMP '2026-04-13 11:01:00'"}) + " FROM customer")
def stored_baselines(spark, sf_dir):
    c, root = fx.table(spark, sf_dir, "customer"), folder(spark)
    i = F.col("c_custkey")
    rows = in_layout(c, fv.BASELINE_COLUMNS, **{
        "user_id": F.col("c_name"), "user_name": F.concat(F.lit("n, "), i.cast("string")), "department": F.col("c_mktsegment"),
        "lambda": F.lit("0.3"), "baseline_ewma": F.col("c_acctbal"), "deviation_ratio": F.lit("NaN"), "anomaly_threshold": F.lit(" 2.0"),
        "current_ewma": F.when(i % 3 > 0, (i / 8.0).cast("string")), "last_updated": F.lit("2026-04-13 11:01:00")})
    tables.write_table(rows, f"{root}/{tables.FILES['ewma_baselines'][0]}", fv.BASELINE_COLUMNS)
    return result(tables.load(spark, root, "ewma_baselines"))


@query("stored_audit", "SELECT " + outcome(
    fv.BLOCKED_AUDIT_COLUMNS, event_id="CAST(o_orderkey AS VARCHAR)", timestamp="CAST(o_orderdate AS TIMESTAMP)", user_id="CAST(o_custkey AS VARCHAR)",
    score="o_orderkey % 100", sbrs="CAST(o_totalprice AS DOUBLE)", reason="'\"' || o_orderpriority || '\", — ' || o_orderstatus",
    duration_min="CASE WHEN o_orderkey % 2 = 0 THEN 60 END") + " FROM orders")
def stored_audit(spark, sf_dir):
    o, root = fx.table(spark, sf_dir, "orders"), folder(spark)
    rows = in_layout(
        o, fv.BLOCKED_AUDIT_COLUMNS, event_id=F.col("o_orderkey"), timestamp=F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        user_id=F.col("o_custkey"), score=F.col("o_orderkey") % 100, sbrs=F.col("o_totalprice"),
        reason=F.concat(F.lit('"'), "o_orderpriority", F.lit('", — '), "o_orderstatus"),
        duration_min=F.when(F.col("o_orderkey") % 2 == 0, F.lit("60.0")).otherwise("60.5"))
    tables.write_table(rows, f"{root}/{tables.FILES['blocked_audit'][0]}", fv.BLOCKED_AUDIT_COLUMNS)
    return result(tables.load(spark, root, "blocked_audit"))


SESSION_COLS = ("hour_index", "calls", "file_class", "endpoint_class", "geo_index", "permission_scope_delta", "collaboration_density",
                "is_true_threat", "threat_class", "is_benign_burst", "episode_id", "split", "pii_sensitivity_score")


@query("stored_sessions", fx.sql("SELECT CAST(user_id AS VARCHAR) AS user_id, \"timestamp\", " + ", ".join(SESSION_COLS[:-1])
                                 + ", s AS pii_sensitivity_score, CAST(NULL AS DOUBLE) AS time_gap_sec FROM lab", "lab"))
def stored_sessions(spark, sf_dir):
    """Sessions without a label carry NaN or an empty text."""
    lab, root = fx.labelled(spark, sf_dir), folder(spark)
    rows = in_layout(lab, fv.SESSION_COLUMNS, **{
        **{c: F.col(c) for c in SESSION_COLS[:-1]}, "user_id": F.col("user_id"), "pii_sensitivity_score": F.col("s"),
        "timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "time_gap_sec": F.lit(""),
        "threat_class": F.coalesce("threat_class", F.when(F.col("hour_index") % 2 == 0, "NaN").otherwise(""))})
    tables.write_table(rows, root, fv.SESSION_COLUMNS)
    return result(tables.read_sessions(spark, root).select("user_id", "timestamp", *SESSION_COLS, "time_gap_sec"))


@query("stored_log", "SELECT url AS value FROM pages WHERE url IS NOT NULL")
def stored_log(spark, sf_dir):
    root = folder(spark)
    fx.table(spark, sf_dir, "pages").select("url").dropna().write.text(root)
    return tables.read_log(spark, root)


# --- nested documents ---------------------------------------------------------------------
def write_documents(rows: DataFrame, chunk: Column, name: str, path: str, **extra: Column) -> None:
    """One JSON document per file, each with the rows of one chunk (of bounded size)."""
    docs = rows.select(chunk.alias("_chunk"), F.struct(*rows.columns).alias("_row")).groupBy("_chunk").agg(
        F.collect_list("_row").alias(name))
    docs.select(*[v.alias(k) for k, v in extra.items()], name).write.option("maxRecordsPerFile", 1).json(path)


def write_events(spark, sf_dir, path):
    e = event_docs.documents(spark, sf_dir)
    write_documents(e, F.substring("event_id", 5, 20).cast("bigint") % F.ceil(F.lit(e.count() / CHUNK)), "events", path, log_metadata=F.struct(
        F.lit("run").alias("run_id"), F.size("events").cast("bigint").alias("total_events")))


EVENT_FIELDS = {"event_id": "event_id", "timestamp": "\"timestamp\"", "event_type": "event_type", "user_id": "user_id", "file_name": "file_name",
                "geo_location": "geo_location", "rate": "rate", "reported": "reported", "action": "enforcement_action"}
EVENT_SQL = fx.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in EVENT_FIELDS.items())
                   + ", CASE WHEN has_pii THEN CASE WHEN k % 8 = 3 THEN 3 ELSE 2 END END AS entities FROM evd", "evd",
                   extra=event_docs.SQL)


def event_fields(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "timestamp", "event_type", "request.user_id", "request.file_name", "request.geo_location",
        F.col("request.activity_rate_per_hour").alias("rate"), F.col("pii_detection.sensitivity_score").alias("reported"),
        F.col("enforcement.action").alias("action"),
        F.when(F.col("pii_detection").isNotNull(), F.size("pii_detection.entities_detected")).alias("entities"))


@query("stored_event_documents", EVENT_SQL)
def stored_event_documents(spark, sf_dir):
    root = folder(spark)
    write_events(spark, sf_dir, root)
    return event_fields(tables.read_events_document(spark, root)[0])


@query("stored_event_lines", EVENT_SQL)
def stored_event_lines(spark, sf_dir):
    root = folder(spark)
    event_docs.documents(spark, sf_dir).write.json(root)
    return event_fields(tables.read_event_lines(spark, root))


@query("stored_ground_truth", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 3 = 0 AS text_document, text, lang AS first_value
    FROM documents""")
def stored_ground_truth(spark, sf_dir):
    """Text and image documents with nested gold entities."""
    d, root = fx.table(spark, sf_dir, "documents"), folder(spark)
    category = F.element_at(F.array(*map(F.lit, fv.CATEGORIES)), (F.col("doc_id") % 3 + 1).cast("int"))
    gold = F.array(F.struct(F.lit("PERSON").alias("type"), F.col("lang").alias("value")))
    rows = d.select(F.col("doc_id").cast("string").alias("doc_id"), category.alias("category"), "text", gold.alias("entities"))
    write_documents(rows, F.floor(F.col("doc_id").cast("bigint") / CHUNK), "documents", root)
    text, images = tables.read_ground_truth(spark, root)
    parts = [df.select("doc_id", F.lit(flag).alias("text_document"), "text", F.col("entities")[0]["value"].alias("first_value"))
             for df, flag in ((text, True), (images, False))]
    return parts[0].unionByName(parts[1])


# --- load all, metrics, model tables ------------------------------------------------------
@query("stored_row_counts", """SELECT 'pii_scans' AS "table", count(*) AS rows FROM documents UNION ALL
    SELECT 'anomaly_comparison', count(*) FROM events UNION ALL SELECT 'ewma_baselines', count(*) FROM customer UNION ALL
    SELECT 'blocked_audit', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL
    SELECT 'system_log', count(*) FROM pages UNION ALL SELECT 'log_metadata', ceil(count(*) / 5e2)::BIGINT FROM events""")
def stored_row_counts(spark, sf_dir):
    """Every stored table as a cached view, and their sizes."""
    root = folder(spark)
    for key, name in (("pii_scans", "documents"), ("anomaly_comparison", "events"), ("ewma_baselines", "customer"), ("blocked_audit", "orders")):
        layout = tables.LAYOUTS[key]
        tables.write_table(in_layout(fx.table(spark, sf_dir, name), layout), f"{root}/{tables.FILES[key][-1]}", layout)
    write_events(spark, sf_dir, f"{root}/{tables.FILES['events'][0]}")
    fx.table(spark, sf_dir, "pages").select(F.coalesce("url", F.lit(""))).write.text(f"{root}/{tables.FILES['system_log'][0]}")
    return tables.load_all(spark, root)["row_counts"]


def nested(paths: dict[str, str], values: dict[str, Column]) -> Column:
    """A struct with every value at its dotted path."""
    tree: dict = {}
    for name, path in paths.items():
        *parents, leaf = path.split(".")
        node = tree
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = values[name]

    def build(node):
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in node.items()])
    return build(tree)


@query("stored_metrics", "SELECT " + ", ".join(
    f"CAST(count(*) + {i} AS BIGINT) AS {n}" if n in tables.COUNTED else f"(count(*) + {i}) / 8e0 AS {n}"
    for i, n in enumerate(tables.METRIC_PATHS)) + " FROM events")
def stored_metrics(spark, sf_dir):
    """A nested metric document, flattened again."""
    n, root = F.col("n"), folder(spark)
    values = {name: n + i if name in tables.COUNTED else (n + i) / 8.0 for i, name in enumerate(tables.METRIC_PATHS)}
    counted = fx.table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"))
    counted.select(nested(tables.METRIC_PATHS, values).alias("doc")).select("doc.*").coalesce(1).write.json(root)
    return tables.read_metrics(spark, root)


@query("stored_report", """SELECT 'by_type' AS part, event_type AS name, count(*) AS n FROM events GROUP BY event_type UNION ALL
    SELECT 'by_source', source, count(*) FROM documents GROUP BY source""")
def stored_report(spark, sf_dir):
    """Two small reports as parts of one metric document."""
    root = folder(spark)
    parts = {"by_type": fx.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n")),
             "by_source": fx.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))}
    tables.write_metrics(parts, root)
    schema = ", ".join(f"{p} array<struct<name:string,n:bigint>>" for p in parts)
    doc = spark.read.schema(schema).json(root)
    out = [doc.select(F.lit(p).alias("part"), F.inline(p)) for p in parts]
    return out[0].unionByName(out[1])


@query("stored_model", "SELECT t AS \"table\", user_id, n, total FROM (SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events "
       "GROUP BY user_id), (SELECT unnest([" + ", ".join(f"'{t}'" for t in tables.MODEL_TABLES) + "]) AS t)")
def stored_model(spark, sf_dir):
    """Model tables written and loaded as one set."""
    root = folder(spark)
    per_user = fx.activity(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), fx.rd(F.sum("value"), 2).alias("total"))
    tables.save_model({t: per_user.withColumn("table", F.lit(t)) for t in tables.MODEL_TABLES}, root)
    loaded = list(tables.load_model(spark, root).values())
    out = loaded[0]
    for df in loaded[1:]:
        out = out.unionByName(df)
    return out.select("table", "user_id", "n", "total")
