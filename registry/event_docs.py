"""Queries over nested event documents built from the activity and customer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.functions import scores, sql as sql_functions, text as tx
from driftwarden.operators import enforcement, events as ev, ewma, frequent, joins
from driftwarden.session import spread
from driftwarden.sources import payloads
from registry import Book, fixtures as fx
from registry.fixtures import r6

book = Book()
query = book.query
CITY_NAMES = list(fv.CITIES)


def city(i):
    return F.concat(F.element_at(F.array(*[F.lit(c.title()) for c in CITY_NAMES]), (i % len(CITY_NAMES) + 1).cast("int")),
                    F.lit(", XX"))


PROFILE = ("user_name", "department", "platform")


def documents(spark, sf_dir, profiled=True):
    """Events with every optional part missing somewhere; those that need no field of the user's profile don't look it up."""
    a = fx.activity(spark, sf_dir)
    if profiled:
        return nested(joins.lookup_join(spread(a), fx.profiles(spark, sf_dir).select("user_id", *PROFILE), "user_id", by=["event_id"]))
    return unprofiled(a).drop("activity_user")


def unprofiled(a):
    return nested(a.select("*", *[F.lit(None).cast("string").alias(c) for c in PROFILE]), F.col("user_id").alias("activity_user"))


def nested(j, *further):
    """Event documents from activity rows with the user's profile; `further` columns go along."""
    k, v = F.col("k"), F.col("value")

    def opt(cond, value):
        return F.when(~cond, value)

    action = scores.lookup("event_type", {"view": "VIEW", "click": "upload", "signup": "Share", "error": "DELETE",
                                          "purchase": "PERMISSION_CHANGE"})
    request = F.struct(
        opt(k == 99, F.format_string("USR%03d", "user_id")).alias("user_id"), F.col("user_name"), F.col("department"),
        F.col("platform"), F.concat("event_type", F.lit("_"), k.cast("string")).alias("file_name"),
        F.element_at(F.array(*[F.lit(x) for x in ("docx", "PDF", "png", "jpg", "text_extractable", None)]),
                     (k % 6 + 1)).alias("file_type"),
        opt(k % 4 == 0, F.when(k % 4 == 1, "AUDIT").otherwise(F.col("department"))).alias("file_department"),
        action.alias("api_action"),
        F.when(k % 9 == 1, "Atlantis, XX").when(k % 9 == 0, None).when(k < 60, city(F.col("user_id")))
        .otherwise(city(k)).alias("geo_location"),
        opt(k % 7 == 0, v).alias("activity_rate_per_hour"))

    def entity(kind, count, tier, weight, contribution):
        return F.struct(kind.alias("type"), count.cast("bigint").alias("count"), tier.alias("sensitivity_tier"),
                        weight.cast("bigint").alias("weight"), contribution.cast("bigint").alias("contribution"))

    none = F.lit(None)
    ents = F.array(entity(F.lit("NID"), k % 4, F.lit("high"), F.lit(10), 10 * (k % 4)),
                   entity(F.lit("EMAIL"), k % 6, F.lit("MEDIUM"), none, none))
    odd = F.array(entity(none.cast("string"), none, none.cast("string"), none, none))
    found = F.struct(
        none.cast("string").alias("engine"), F.when(k % 15 == 2, "Branch3_VLM").alias("branch"),
        F.when(k % 5 == 0, "N/A").when(k % 5 == 1, "").when(k % 5 == 3, ((k * 37 % 51 + 50) / 100.0).cast("string"))
        .when(k % 5 == 4, "low").alias("ocr_confidence"),
        *[opt(k % 13 == 5, (k % m).cast("bigint")).alias(n) for n, m in
          (("high_count", 4), ("medium_count", 6), ("low_count", 8))],
        F.when(k % 3 == 0, -1).when(k % 3 == 2, F.least(F.lit(100), F.floor(v).cast("int"))).cast("bigint").alias("sensitivity_score"),
        F.when(k % 17 == 0, "SENSITIVE").alias("risk_category"), F.when(k % 2 == 0, v).alias("processing_ms"),
        F.when(k % 8 == 3, F.concat(ents, odd)).otherwise(ents).alias("entities_detected"))
    return j.select(
        F.format_string("EVT-%08d", "event_id").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        opt(k % 10 == 3, F.col("event_type")).alias("event_type"), F.when(k % 20 == 1, "Branch1_Presidio").alias("module"),
        request.alias("request"), F.when(k % 11 != 0, found).alias("pii_detection"),
        F.when(k % 12 != 0, F.struct(F.when(k % 2 == 0, "ALERT").otherwise("PERMIT").alias("action"),
                                     F.lit("policy").alias("reason"))).alias("enforcement"), *further)


def baselines(spark, sf_dir):
    """Stored baselines of even and third users; other users have none."""
    out = ewma.horizon_baselines(fx.activity(spark, sf_dir), "value")
    kept = out.filter((F.col("user_id") % 3 != 1) & ~((F.col("time_window") == "1h") & (F.col("user_id") % 3 == 2)))
    rank = F.element_at(F.create_map(*[x for i, w in enumerate(fv.EWMA_WINDOWS) for x in (F.lit(w[0]), F.lit(i))]),
                        F.col("time_window"))
    return kept.withColumns({"position": rank, "user_id": F.format_string("USR%03d", "user_id"),
                             "current_ewma": F.when(F.col("user_id") % 5 != 0, F.col("current_ewma")).otherwise(0.0)})


_CITY_LIST = "[" + ", ".join(f"'{c.title()}, XX'" for c in CITY_NAMES) + "]"


def _coord(axis, geo):
    return (f"CASE lower(trim(split_part({geo}, ',', 1))) " + " ".join(
        f"WHEN '{c}' THEN CAST({xy[axis]} AS DOUBLE)" for c, xy in fv.CITIES.items()) + " END")


SQL = {
    "evd": f"""SELECT printf('EVT-%08d', event_id) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp",
        CASE WHEN k % 10 <> 3 THEN event_type END AS event_type, CASE WHEN k % 20 = 1 THEN 'Branch1_Presidio' END AS module,
        CASE WHEN k <> 99 THEN printf('USR%03d', act.user_id) END AS user_id, user_name, department, platform,
        event_type || '_' || k AS file_name, ['docx', 'PDF', 'png', 'jpg', 'text_extractable', NULL][k % 6 + 1] AS file_type,
        CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'AUDIT' ELSE department END AS file_department,
        CASE event_type WHEN 'view' THEN 'VIEW' WHEN 'click' THEN 'upload' WHEN 'signup' THEN 'Share' WHEN 'error' THEN 'DELETE'
            ELSE 'PERMISSION_CHANGE' END AS api_action,
        CASE WHEN k % 9 = 1 THEN 'Atlantis, XX' WHEN k % 9 = 0 THEN NULL WHEN k < 60 THEN {_CITY_LIST}[act.user_id % 13 + 1]
            ELSE {_CITY_LIST}[k % 13 + 1] END AS geo_location,
        CASE WHEN k % 7 <> 0 THEN value END AS rate, k % 11 <> 0 AS has_pii,
        CASE WHEN k % 11 <> 0 AND k % 15 = 2 THEN 'Branch3_VLM' END AS pii_branch,
        CASE WHEN k % 11 <> 0 AND k % 5 = 3 THEN (k * 37 % 51 + 50) / 1e2 END AS confidence,
        CASE WHEN k % 11 <> 0 AND k % 13 <> 5 THEN k % 4 ELSE 0 END AS h, CASE WHEN k % 11 <> 0 AND k % 13 <> 5 THEN k % 6 ELSE 0 END AS m,
        CASE WHEN k % 11 <> 0 AND k % 13 <> 5 THEN k % 8 ELSE 0 END AS l,
        CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN -1 WHEN k % 3 = 2 THEN least(100, CAST(floor(value) AS INT)) END AS reported,
        CASE WHEN k % 11 <> 0 AND k % 17 = 0 THEN 'SENSITIVE' END AS stated_category,
        CASE WHEN k % 11 <> 0 AND k % 2 = 0 THEN value ELSE 0e0 END AS processing_ms, k,
        CASE WHEN k % 12 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'ALERT' ELSE 'PERMIT' END END AS enforcement_action
        FROM act LEFT JOIN prof ON prof.user_id = act.user_id""",
    "scan": f"""SELECT *, CASE WHEN reported >= 0 THEN reported ELSE least(10 * h + 5 * m + l, 100) END AS score,
        coalesce(module, pii_branch, CASE WHEN contains(lower(coalesce(file_type, '')), 'text') OR lower(coalesce(file_type, '')) IN
        ('docx', 'pdf', 'txt', 'csv', 'xlsx', 'py', 'env') THEN 'Branch1_Presidio' WHEN confidence IS NULL OR confidence >= 85e-2
        THEN 'Branch2_PaddleOCR' ELSE 'Branch3_VLM' END) AS branch FROM evd""",
    "homes": """SELECT user_id, geo_location AS home FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_seen) AS rn
        FROM (SELECT user_id, geo_location, count(*) AS n, min(event_id) AS first_seen FROM evd WHERE user_id IS NOT NULL
        AND geo_location IS NOT NULL GROUP BY ALL)) WHERE rn = 1""",
    "slots": """SELECT user_id, w.name AS time_window, w.lam AS lam, w.pos AS pos, CAST(floor(epoch(ts) / w.sec) AS BIGINT) AS bucket,
        round(sum(value), 2) AS x, max(ts) AS last_updated FROM act, (SELECT unnest([""" + ", ".join(
            f"{{'name': '{n}', 'lam': CAST({l} AS DOUBLE), 'sec': {s}, 'pos': {i}}}" for i, (n, l, s) in enumerate(fv.EWMA_WINDOWS)) + """]) AS w)
        GROUP BY ALL""",
    "slotseq": "SELECT *, row_number() OVER (PARTITION BY user_id, time_window ORDER BY bucket) AS rn FROM slots",
    "slotew": """SELECT user_id, time_window, lam, pos, rn, x AS p, x AS n, last_updated FROM slotseq WHERE rn = 1 UNION ALL
        SELECT q.user_id, q.time_window, q.lam, q.pos, q.rn, e.n, q.lam * q.x + (1e0 - q.lam) * e.n, q.last_updated
        FROM slotew e JOIN slotseq q ON q.user_id = e.user_id AND q.time_window = e.time_window AND q.rn = e.rn + 1""",
    "hbase": """SELECT user_id, time_window, lam, pos, p AS baseline_ewma, n AS current_ewma, abs(n - p) / greatest(p, 1e-6) AS deviation_ratio,
        last_updated FROM (SELECT *, row_number() OVER (PARTITION BY user_id, time_window ORDER BY rn DESC) AS back FROM slotew) WHERE back = 1""",
    "stored": """SELECT printf('USR%03d', user_id) AS user_id, time_window, pos, baseline_ewma,
        CASE WHEN user_id % 5 <> 0 THEN current_ewma ELSE 0e0 END AS current_ewma, deviation_ratio FROM hbase
        WHERE user_id % 3 <> 1 AND NOT (time_window = '1h' AND user_id % 3 = 2)""",
    "ubase": """SELECT user_id, coalesce(CASE WHEN current_ewma > 0 THEN current_ewma END, CASE WHEN baseline_ewma > 0 THEN baseline_ewma END) AS ewma_baseline
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (time_window = '1h') DESC, pos DESC) AS rn FROM stored) WHERE rn = 1""",
    "ctx": f"""SELECT evd.*, ewma_baseline, home, {_coord(0, 'geo_location')} AS la, {_coord(1, 'geo_location')} AS lo,
        {_coord(0, 'home')} AS hla, {_coord(1, 'home')} AS hlo FROM evd LEFT JOIN ubase USING (user_id) LEFT JOIN homes USING (user_id)""",
    "evf": """SELECT event_id, CASE WHEN rate IS NOT NULL AND rate <> 0 AND ewma_baseline IS NOT NULL THEN greatest(0e0, least(1e1, rate / ewma_baseline))
        ELSE 1e0 END AS activity_rate, CASE WHEN reported IS NULL THEN 1e0 / 3e0 WHEN reported >= 75 THEN 1e0 WHEN reported >= 50 THEN 2e0 / 3e0
        WHEN reported >= 18 THEN 1e0 / 3e0 ELSE 0e0 END AS file_type_category,
        CASE WHEN la IS NOT NULL AND hla IS NOT NULL THEN least(1e0, 6371e0 * 2e0 * asin(sqrt(pow(sin((radians(hla) - radians(la)) / 2e0), 2)
            + cos(radians(la)) * cos(radians(hla)) * pow(sin((radians(hlo) - radians(lo)) / 2e0), 2))) / 5000e0)
            WHEN la IS NOT NULL OR hla IS NOT NULL THEN 0e0 ELSE 5e-1 END AS geo_index,
        CASE upper(api_action) WHEN 'UPLOAD' THEN 25e-2 WHEN 'SHARE' THEN 5e-1 WHEN 'DELETE' THEN 75e-2 WHEN 'PERMISSION_CHANGE' THEN 1e0
            ELSE 0e0 END AS endpoint_operation,
        CASE WHEN file_department IS NULL OR file_department = department THEN 0e0 ELSE 15e-2 END AS permission_scope_delta,
        round_even((3e-1 * rate + 7e-1 * ewma_baseline) * 1e4, 0) / 1e4 AS ewma_score,
        (rate - ewma_baseline) / greatest(ewma_baseline, 1e-6) > 25e-1 AS ewma_flagged FROM ctx""",
}


def esql(body, *names):
    return fx.sql(body, *names, extra=SQL)


def esql_with(body, extra, *names):
    """The same with further expressions."""
    return fx.sql(body, *names, extra={**SQL, **extra})


# --- listings ---------------------------------------------------------------------
@query("event_listing", esql("""SELECT event_id, "timestamp", event_type, module, user_id, user_name, department, platform, file_name,
    file_type, api_action, enforcement_action FROM evd WHERE event_type = 'purchase'""", "evd"))
def event_listing(spark, sf_dir):
    """All purchases, flat (no row limit, so that whole tables compare)."""
    return ev.list_events(documents(spark, sf_dir), "purchase", limit=None)


@query("first_events", esql("""SELECT event_id, "timestamp", user_id, file_name, enforcement_action FROM evd ORDER BY event_id LIMIT 200""", "evd"))
def first_events(spark, sf_dir):
    """The API's first page, in id order."""
    flat = ev.list_events(documents(spark, sf_dir), limit=None).orderBy("event_id").limit(200)
    return flat.select("event_id", "timestamp", "user_id", "file_name", "enforcement_action")


@query("event_lookup", esql("SELECT event_id, user_id, file_name, CASE WHEN has_pii THEN k % 4 END AS nid_count FROM evd WHERE event_id = 'EVT-00000123'", "evd"))
def event_lookup(spark, sf_dir):
    found = ev.get_event(documents(spark, sf_dir), "EVT-00000123")
    return found.select("event_id", "request.user_id", "request.file_name",
                        F.col("pii_detection.entities_detected")[0]["count"].cast("int").alias("nid_count"))


@query("event_ids", esql("SELECT event_id FROM evd", "evd"))
def event_ids(spark, sf_dir):
    return ev.event_ids(documents(spark, sf_dir, profiled=False))


@query("event_summaries", esql("""SELECT event_id, "timestamp", coalesce(user_id, '?') AS user_id, user_name, department, platform, file_name,
    coalesce(file_type, '?') AS file_type, api_action, coalesce(event_type, '?') AS event_type FROM evd""", "evd"))
def event_summaries(spark, sf_dir):
    return documents(spark, sf_dir).select(ev.event_summary().alias("e")).select("e.*")


@query("service_summary", """SELECT 'run-1' AS run_id, count(*) AS total_events, count(DISTINCT user_id) AS users_monitored, 2 AS n_platforms FROM events""")
def service_summary(spark, sf_dir):
    a = fx.activity(spark, sf_dir)
    meta = a.agg(F.lit("run-1").alias("run_id"), F.count(F.lit(1)).alias("total_events"),
                 F.count_distinct("user_id").alias("users_monitored"),
                 F.array(F.lit("Google Drive"), F.lit("Microsoft OneDrive")).alias("saas_platforms"),
                 F.array().cast("array<string>").alias("pii_branches"), F.array().cast("array<string>").alias("anomaly_engines"))
    return ev.service_summary(meta).select("run_id", "total_events", "users_monitored", F.size("saas_platforms").alias("n_platforms"))


@query("user_aliases", """SELECT event_id, CASE user_id """ + " ".join(
    f"WHEN {int(u[3:])} THEN '{a}'" for u, a in fv.USER_ALIASES.items()) + """ ELSE 'John Doe' END AS alias,
    rpad(CASE user_id """ + " ".join(f"WHEN {int(u[3:])} THEN '{a}'" for u, a in fv.USER_ALIASES.items())
    + """ ELSE 'John Doe' END, 13, ' ') || ' -> ' || event_type AS label FROM events""")
def user_aliases(spark, sf_dir):
    a = fx.activity(spark, sf_dir)
    alias = ev.alias_of(F.format_string("USR%03d", "user_id"))
    return a.select("event_id", alias.alias("alias"),
                    F.concat(F.rpad(alias, 13, " "), F.lit(" -> "), "event_type").alias("label"))


@query("nearest_sensitivity_event", esql("SELECT event_id, reported AS sensitivity_score FROM evd ORDER BY abs(coalesce(reported, 0) - 40), event_id LIMIT 1", "evd"))
def nearest_sensitivity_event(spark, sf_dir):
    out = ev.nearest_to_target(documents(spark, sf_dir))
    return out.select("event_id", F.col("pii_detection.sensitivity_score").cast("int").alias("sensitivity_score"))


# --- personal data of events -----------------------------------------------------------
@query("event_pii_results", esql("""SELECT event_id, branch, confidence AS ocr_confidence, h AS high_count, m AS medium_count, l AS low_count,
    score AS sensitivity_score, coalesce(stated_category, CASE WHEN score >= 70 THEN 'HIGH-RISK' WHEN score >= 20 THEN 'SENSITIVE' ELSE 'SAFE' END)
    AS risk_category, processing_ms FROM scan""", "scan"))
def event_pii_results(spark, sf_dir):
    cols = ev.pii_columns()
    cast = {c: cols[c].cast("int") for c in ("high_count", "medium_count", "low_count", "sensitivity_score")}
    return documents(spark, sf_dir).select("event_id", *[{**cols, **cast}[c].alias(c) for c in (
        "branch", "ocr_confidence", "high_count", "medium_count", "low_count", "sensitivity_score", "risk_category", "processing_ms")])


@query("event_branches", esql("SELECT branch, count(*) AS events FROM scan GROUP BY branch", "scan"))
def event_branches(spark, sf_dir):
    return documents(spark, sf_dir).select(ev.pii_columns()["branch"].alias("branch")).groupBy("branch").agg(
        F.count(F.lit(1)).alias("events"))


@query("normalised_entities", esql("""SELECT event_id, unnest(['NID', 'EMAIL'] || CASE WHEN k % 8 = 3 THEN ['UNKNOWN'] ELSE [] END) AS type,
    unnest([k % 4, k % 6] || CASE WHEN k % 8 = 3 THEN [0] ELSE [] END) AS count, unnest(['HIGH', 'MEDIUM'] || CASE WHEN k % 8 = 3 THEN ['LOW'] ELSE [] END)
    AS sensitivity_tier, unnest([10, 5] || CASE WHEN k % 8 = 3 THEN [1] ELSE [] END) AS weight,
    unnest([10 * (k % 4), 5 * (k % 6)] || CASE WHEN k % 8 = 3 THEN [0] ELSE [] END) AS contribution FROM evd WHERE has_pii""", "evd"))
def normalised_entities(spark, sf_dir):
    full = ev.normalised_entities(F.col("pii_detection.entities_detected"))
    rows = documents(spark, sf_dir).select("event_id", F.inline(full))
    return rows.withColumns({c: F.col(c).cast("int") for c in ("count", "weight", "contribution")})


@query("entity_derivation_check", esql("""SELECT count(*) FILTER (WHERE has_pii) AS verified,
    sum(CASE WHEN has_pii THEN 1 + CAST(k % 8 = 3 AS INT) ELSE 0 END)::BIGINT AS derived, count(*) FILTER (WHERE has_pii AND k % 9 = 4) AS mismatches FROM evd""", "evd"))
def entity_derivation_check(spark, sf_dir):
    """Stated contributions of some files are wrong by one."""
    wrong = F.regexp_extract("request.file_name", "([0-9]+)$", 1).cast("int") % 9 == 4
    entities = F.transform("pii_detection.entities_detected", lambda e: e.withField(
        "contribution", F.when(wrong, e["contribution"] + 1).otherwise(e["contribution"])))
    found = F.when(F.col("pii_detection").isNotNull(), F.col("pii_detection").withField("entities_detected", entities))
    return ev.derivation_check(documents(spark, sf_dir).withColumn("pii_detection", found))


@query("sensitivity_scores", """SELECT event_id, CAST(least(10 * h + 5 * m + l, 100) AS INT) AS score, CASE WHEN least(10 * h + 5 * m + l, 100) >= 70
    THEN 'BLOCK' WHEN least(10 * h + 5 * m + l, 100) >= 20 THEN 'ALERT' ELSE 'PERMIT' END AS action FROM (
    SELECT event_id, k % 7 AS h, k % 5 AS m, k AS l FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))""")
def sensitivity_scores(spark, sf_dir):
    a = fx.activity(spark, sf_dir).select("event_id", (F.col("k") % 7).alias("h"), (F.col("k") % 5).alias("m"), F.col("k").alias("l"))
    s = scores.sensitivity("h", "m", "l")
    return a.select("event_id", s.alias("score"), scores.action_for(scores.risk_category(s)).alias("action"))


@query("risk_scores", """SELECT event_id, round_even(v * 1e4, 0) / 1e4 AS sbrs_value, CASE WHEN v >= 184e-2 THEN 'HIGH-RISK' WHEN v >= 122e-2 THEN 'SENSITIVE'
    ELSE 'SAFE' END AS sbrs_category, CASE WHEN v >= 184e-2 THEN 'BLOCK' WHEN v >= 122e-2 THEN 'ALERT' ELSE 'PERMIT' END AS enforcement_action,
    s AS sensitivity_score FROM (SELECT event_id, s, s * (1e0 + 25e-1 * a) / 1e2 AS v FROM (
    SELECT event_id, least(100, CAST(trunc(value) AS INT)) AS s, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 99e0 AS a FROM events))""")
def risk_scores(spark, sf_dir):
    a = fx.activity(spark, sf_dir)
    return a.select("event_id", scores.serving_sbrs("value", F.col("k") / 99.0).alias("r")).select(
        "event_id", "r.sbrs_value", "r.sbrs_category", "r.enforcement_action", "r.sensitivity_score")


@query("parameter_violations", """SELECT unnest(['value_0_100', 'k_0_90']) AS rule, unnest([count(*) FILTER (WHERE NOT value BETWEEN 0 AND 100),
    count(*) FILTER (WHERE NOT CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) BETWEEN 0 AND 90)]) AS violations FROM events""")
def parameter_violations(spark, sf_dir):
    return enforcement.violations(fx.activity(spark, sf_dir), {"value_0_100": F.col("value").between(0, 100),
                                                               "k_0_90": F.col("k").between(0, 90)})


@query("lenient_parsing", """SELECT doc_id, source, TRY_CAST(regexp_extract(text, '[0-9]+') AS DOUBLE) AS number FROM documents""")
def lenient_parsing(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", tx.parse_number(F.regexp_extract("text", "[0-9]+", 0)).alias("number"))


@query("wilson_intervals", """SELECT user_id, round(greatest(0e0, (k / n + 38416e-4 / (2e0 * n)) / (1e0 + 38416e-4 / n)
    - 196e-2 * sqrt((k / n) * (1e0 - k / n) / n + 38416e-4 / (4e0 * n * n)) / (1e0 + 38416e-4 / n)), 6) AS lo,
    round(least(1e0, (k / n + 38416e-4 / (2e0 * n)) / (1e0 + 38416e-4 / n)
    + 196e-2 * sqrt((k / n) * (1e0 - k / n) / n + 38416e-4 / (4e0 * n * n)) / (1e0 + 38416e-4 / n)), 6) AS hi
    FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS k FROM events GROUP BY user_id)""")
def wilson_intervals(spark, sf_dir):
    c = fx.activity(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    lo, hi = scores.wilson_bounds("k", "n")
    return c.select("user_id", r6(lo, "lo"), r6(hi, "hi"))


@query("time_parts", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS label, hour(ts) AS hour, (dayofweek(ts) + 6) % 7 AS weekday,
    CAST(date_diff('hour', (SELECT date_trunc('hour', min(ts)) FROM events), date_trunc('hour', ts)) AS BIGINT) AS hour_index FROM events""")
def time_parts(spark, sf_dir):
    a = fx.activity(spark, sf_dir)
    start = a.agg(F.unix_seconds(F.date_trunc("hour", F.min("ts")))).scalar()
    index = F.floor((F.unix_seconds(F.date_trunc("hour", "ts")) - start) / 3600)
    return a.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("label"), F.hour("ts").alias("hour"),
                    F.weekday("ts").alias("weekday"), index.cast("bigint").alias("hour_index"))


# --- the same in SQL, and ad-hoc payloads ----------------------------------------------------
def by_sql(spark, sf_dir, text):
    """A query in Spark SQL over the activity rows, with the registered functions."""
    sql_functions.register(spark)
    return spark.sql(text, activity=fx.activity(spark, sf_dir))


@query("sql_sensitivity_scores", book.ORACLE["sensitivity_scores"])
def sql_sensitivity_scores(spark, sf_dir):
    return by_sql(spark, sf_dir, """SELECT event_id, score, category_action(sensitivity_category(score)) AS action
        FROM (SELECT event_id, sensitivity_score(k % 7, k % 5, k) AS score FROM {activity})""")


@query("sql_risk_scores", book.ORACLE["risk_scores"])
def sql_risk_scores(spark, sf_dir):
    return by_sql(spark, sf_dir, """SELECT event_id, half_even(v, 4) AS sbrs_value, risk_category(v) AS sbrs_category,
        risk_action(v) AS enforcement_action, s AS sensitivity_score FROM (SELECT event_id, s, risk_value(s, k / 99D) AS v
            FROM (SELECT event_id, k, least(100, CAST(value AS INT)) AS s FROM {activity}))""")


@query("sql_wilson_intervals", book.ORACLE["wilson_intervals"])
def sql_wilson_intervals(spark, sf_dir):
    return by_sql(spark, sf_dir, """SELECT user_id, round(i.low, 6) AS lo, round(i.high, 6) AS hi
        FROM (SELECT user_id, count(*) AS n, count_if(event_type = 'error') AS k FROM {activity} GROUP BY user_id) u, LATERAL wilson_interval(u.k, u.n) i""")


@query("sql_ewma_steps", """SELECT event_id, round_even((3e-1 * value + 7e-1 * b) * 1e4, 0) / 1e4 AS ewma_score, (value - b) / greatest(b, 1e-6) > 25e-1 AS ewma_flagged,
    round(greatest(0e0, least(1e1, CASE WHEN value <> 0 AND b <> 0 THEN value / b ELSE 1e0 END)), 6) AS activity_rate
    FROM events JOIN (SELECT user_id, round(avg(value), 2) AS b FROM events GROUP BY user_id) USING (user_id)""")
def sql_ewma_steps(spark, sf_dir):
    """Every event against its user's mean."""
    return by_sql(spark, sf_dir, """WITH base AS (SELECT user_id, round(avg(value) * 100D) / 100D AS b FROM {activity} GROUP BY user_id)
        SELECT event_id, half_even(ewma_step(value, b), 4) AS ewma_score, ewma_deviation(value, b) > 2.5D AS ewma_flagged,
               round(activity_ratio(value, b), 6) AS activity_rate FROM {activity} JOIN base USING (user_id)""")


@query("sql_actions_per_user", """SELECT user_id, a AS action, count(*) AS n, round(max(v), 6) AS worst FROM (SELECT user_id, v,
    CASE WHEN v >= 184e-2 THEN 'BLOCK' WHEN v >= 122e-2 THEN 'ALERT' ELSE 'PERMIT' END AS a FROM (
    SELECT user_id, least(1e2, value) * (1e0 + 3e0 * CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 99e0) / 1e2 AS v FROM events)) GROUP BY 1, 2""")
def sql_actions_per_user(spark, sf_dir):
    """Actions per user at another weight of behaviour, given by name."""
    return by_sql(spark, sf_dir, """SELECT user_id, risk_action(v) AS action, count(*) AS n, round(max(v), 6) AS worst
        FROM (SELECT user_id, risk_value(least(100D, value), k / 99D, beta => 3D) AS v FROM {activity}) GROUP BY ALL""")


@query("payload_pii_results", esql("""SELECT event_id, branch, h AS high_count, m AS medium_count, l AS low_count, score AS sensitivity_score,
    CASE WHEN k % 4 = 0 THEN 'trace,zone' ELSE 'trace' END AS unknown, CAST(substr(event_id, 5) AS BIGINT) AS trace_id FROM scan""", "scan"))
def payload_pii_results(spark, sf_dir):
    """Events as JSON payloads with unknown fields and mistyped ones, parsed once as VARIANT and scored."""
    d = documents(spark, sf_dir, profiled=False)
    k = F.regexp_extract("request.file_name", "([0-9]+)$", 1).cast("int")
    odd = F.struct(F.struct(F.substring("event_id", 5, 20).cast("bigint").alias("id")).alias("trace"), F.when(k % 4 == 0, "eu").alias("zone"),
                   F.when(k % 3 == 0, F.array(F.lit(1))).alias("timestamp"), *[c for c in d.columns if c != "timestamp"])
    rows = payloads.events_of(payloads.parsed(d.select(F.to_json(odd).alias("payload"))))
    cols = ev.pii_columns()
    return rows.select("event_id", cols["branch"].alias("branch"), *[cols[c].cast("int").alias(c) for c in ("high_count", "medium_count", "low_count", "sensitivity_score")],
                       F.array_join(payloads.unknown_fields(F.col("payload")), ",").alias("unknown"),
                       payloads.field(F.col("payload"), "$.trace.id", "bigint").alias("trace_id"))


# --- per-user context ----------------------------------------------------------------------
@query("horizon_baselines", esql("""SELECT user_id, time_window, lam AS "lambda", round(baseline_ewma, 6) AS baseline_ewma,
    round(current_ewma, 6) AS current_ewma, round(deviation_ratio, 6) AS deviation_ratio,
    CASE WHEN deviation_ratio > 2 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS status, strftime(last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated
    FROM hbase""", "hbase"))
def horizon_baselines(spark, sf_dir):
    out = ewma.horizon_baselines(fx.activity(spark, sf_dir), "value")
    return out.select("user_id", "time_window", "lambda", r6("baseline_ewma", "baseline_ewma"), r6("current_ewma", "current_ewma"),
                      r6("deviation_ratio", "deviation_ratio"), "status",
                      F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))


@query("user_baseline_rows", esql("""SELECT time_window, lam AS "lambda", strftime(last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated FROM hbase
    WHERE user_id = 8""", "hbase"))
def user_baseline_rows(spark, sf_dir):
    """Baselines of one user, timestamps as text."""
    out = ewma.horizon_baselines(fx.activity(spark, sf_dir), "value").filter("user_id = 8")
    return out.select("time_window", "lambda", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))


@query("user_baselines", esql("SELECT user_id, round(ewma_baseline, 6) AS ewma_baseline FROM ubase", "ubase"))
def user_baselines(spark, sf_dir):
    return ev.baseline_of_users(baselines(spark, sf_dir)).select("user_id", r6("ewma_baseline", "ewma_baseline"))


@query("last_event_per_user", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def last_event_per_user(spark, sf_dir):
    a = fx.activity(spark, sf_dir)
    return joins.last_per_key(a, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("habitual_origins", esql("SELECT user_id, home FROM homes", "homes"))
def habitual_origins(spark, sf_dir):
    return ev.home_of_users(documents(spark, sf_dir, profiled=False))


CITY_SQL = f"""SELECT user_id, home, {_coord(0, 'home')} AS lat, {_coord(1, 'home')} AS lon FROM homes"""


@query("home_coordinates", esql(CITY_SQL, "homes"))
def home_coordinates(spark, sf_dir):
    return ev.home_of_users(documents(spark, sf_dir, profiled=False)).select(
        "user_id", "home", scores.city_coord("home", 0).alias("lat"), scores.city_coord("home", 1).alias("lon"))


EVF = ("activity_rate", "file_type_category", "geo_index", "endpoint_operation", "permission_scope_delta")


def with_context(spark, sf_dir):
    """Event documents with `ewma_baseline` and `home`.

    The events are read three times in all: for the users' origins, which the sketch of hot users comes along with, for
    their baselines, and for the one join with everything that is known of a user.
    """
    a = fx.activity(spark, sf_dir)
    counts, sketched = frequent.stage_through(unprofiled(a), ["activity_user"], "origins", ev.origin_counts)
    known = ev.baseline_of_users(baselines(spark, sf_dir)).join(ev.home_of_counts(counts), "user_id", "full")
    known = known.select(F.substring("user_id", 4, 20).cast("bigint").alias("user_id"), "ewma_baseline", F.col("home").alias("habit"))
    users = fx.profiles(spark, sf_dir).select("user_id", *PROFILE).join(known, "user_id", "full")
    rows = joins.lookup_join(spread(a), users, "user_id", sketched=sketched.withColumnRenamed("activity_user", "user_id"), by=["event_id"])
    named = F.col("k") != 99
    return nested(rows, F.when(named, F.col("ewma_baseline")).alias("ewma_baseline"), F.when(named, F.col("habit")).alias("home"))


@query("event_features", esql("SELECT event_id, " + ", ".join(f"round_even({c} * 1e4, 0) / 1e4 AS {c}" for c in EVF) + " FROM evf", "evf"))
def event_features(spark, sf_dir):
    cols = ev.feature_columns(F.lit(0.0))
    return with_context(spark, sf_dir).select("event_id", *[cols[c].alias(c) for c in EVF])


@query("event_ewma_steps", esql("SELECT event_id, ewma_score, ewma_flagged FROM evf", "evf"))
def event_ewma_steps(spark, sf_dir):
    cols = ev.ewma_columns(2.5)
    return with_context(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in cols.items()])


@query("stats_with_fallback", fx.sql("""SELECT customer.c_custkey AS user_id, round(coalesce(mu_0, g0), 6) AS mu_0, round(coalesce(sd_5, g5), 6) AS sd_5
    FROM customer LEFT JOIN pstats ON pstats.user_id = c_custkey, (SELECT avg(mu_0) AS g0, avg(sd_5) AS g5 FROM pstats)""", "pstats"))
def stats_with_fallback(spark, sf_dir):
    """Customers without activity take the global statistics."""
    from driftwarden.operators import sessions
    stats = sessions.personal_stats(fx.features(spark, sf_dir)).select("user_id", "mu_0", "sd_5")
    users = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    out = joins.with_fallback(users, stats, "user_id", stats.agg(F.avg("mu_0").alias("mu_0"), F.avg("sd_5").alias("sd_5")))
    return out.select("user_id", r6("mu_0", "mu_0"), r6("sd_5", "sd_5"))


@query("blocked_audit_dump", fx.sql("""SELECT printf('BLK-%03d', row_number() OVER (ORDER BY user_id, hour_index)) AS event_id,
    strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", user_id, s AS score, round(sbrs_value, 4) AS sbrs FROM scored WHERE hybrid_action = 'BLOCK'""", "scored"))
def blocked_audit_dump(spark, sf_dir):
    """Blocked sessions as audit rows with sequential ids and text timestamps."""
    from driftwarden.operators import ordering
    b = fx.scored(spark, sf_dir).filter(F.col("hybrid_action") == "BLOCK")
    pos = ordering.positions(b, ["user_id", "hour_index"]).select("user_id", "hour_index", "position")
    return b.join(pos, ["user_id", "hour_index"]).select(
        F.format_string("BLK-%03d", "position").alias("event_id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "user_id", F.col("s").alias("score"), fx.rd("sbrs_value", 4).alias("sbrs"))
