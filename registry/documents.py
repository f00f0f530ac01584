"""Queries over documents: recognisers, matching, cascade evaluation, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.functions import scores, text as tx, vectors
from driftwarden.operators import matching, ordering, pii, scoring
from driftwarden.plans import cascade_evaluation
from driftwarden.session import spread
from registry import Book, fixtures as fx
from registry.fixtures import r6, table

book = Book()
query = book.query

B1, B2, B3 = fv.BRANCH1, fv.BRANCH2, fv.BRANCH3
GOLD_PATTERNS = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
                 "PHONE": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "CREDIT_CARD": r"[0-9]{16}", "PERSON": r"[A-Z][a-z]{9,}"}

SQL = {
    "docs": """SELECT doc_id, text, lang, source, CASE doc_id % 3 WHEN 0 THEN 'text_extractable' WHEN 1 THEN 'scanned'
        ELSE 'handwritten' END AS category, CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 37 % 51 + 50) / 1e2 END AS confidence,
        CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN 'not_attempted' WHEN doc_id % 10 = 1 THEN 'malformed_json'
        WHEN doc_id % 10 = 2 THEN 'ok+cached' ELSE 'ok' END AS status FROM documents""",
    "gold": "SELECT doc_id, e.type AS type, e.value AS value FROM (SELECT doc_id, unnest(list_concat(" + ", ".join(
        f"list_transform(regexp_extract_all(text, '{p}'), lambda v: {{'type': '{t}', 'value': v}})"
        for t, p in GOLD_PATTERNS.items()) + ")) AS e FROM documents)",
    "preds": f"""SELECT gold.doc_id, '{B1}' AS branch, type, upper(replace(replace(value, '-', ''), ' ', '')) AS value
            FROM gold JOIN docs USING (doc_id) WHERE category = 'text_extractable' AND NOT (type = 'PERSON' AND doc_id % 4 = 1)
        UNION ALL SELECT gold.doc_id, '{B2}', type, CASE WHEN doc_id % 2 = 0 THEN left(value, length(value) - 1) || 'x'
            ELSE lower(value) END FROM gold JOIN docs USING (doc_id) WHERE category <> 'text_extractable'
        UNION ALL SELECT gold.doc_id, '{B3}', type, ' ' || value FROM gold JOIN docs USING (doc_id)
            WHERE category <> 'text_extractable' AND status LIKE 'ok%'
        UNION ALL SELECT doc_id, '{B3}', 'PERSON', 'Nobody' FROM docs
            WHERE category <> 'text_extractable' AND status LIKE 'ok%' AND doc_id % 5 = 0""",
    "gn": """SELECT doc_id, type, regexp_replace(lower(strip_accents(value)), '[^a-z0-9@]+', '', 'g') AS n, count(*) AS g
        FROM gold GROUP BY ALL""",
    "pn": """SELECT doc_id, branch, type, regexp_replace(lower(strip_accents(value)), '[^a-z0-9@]+', '', 'g') AS n, count(*) AS p
        FROM preds GROUP BY ALL""",
    "avail": f"""SELECT doc_id, category, '{B1}' AS branch FROM docs UNION ALL
        SELECT doc_id, category, '{B2}' FROM docs UNION ALL SELECT doc_id, category, '{B3}' FROM docs""",
    "mc": """SELECT doc_id, branch, type, sum(least(g, p)) AS tp, sum(p - least(g, p)) AS fp, sum(g - least(g, p)) AS fn FROM (
        SELECT doc_id, branch, type, n, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM
        (SELECT avail.branch, gn.* FROM gn JOIN avail USING (doc_id)) FULL JOIN pn USING (doc_id, branch, type, n)) GROUP BY ALL""",
    "routed": f"""SELECT *, CASE WHEN category = 'text_extractable' THEN '{B1}' WHEN confidence >= 85e-2 THEN '{B2}'
        ELSE '{B3}' END AS branch FROM docs""",
    "picked": "SELECT routed.*, type, tp, fp, fn FROM routed JOIN mc USING (doc_id, branch)",
    "base": f"SELECT doc_id, category, type, tp, fp, fn FROM docs JOIN mc USING (doc_id) WHERE branch = '{B1}'",
}
PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END, 6) AS "precision",
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END, 6) AS recall,
    round(CASE WHEN tp > 0 THEN 2e0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0e0 END, 6) AS f1"""
SUMS = ("CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, "
        "CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn")


def dsql(body, *names, **extra):
    return fx.sql(body, *names, extra={**SQL, **extra})


def docs(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    text_doc = i % 3 == 0
    return d.select(
        "doc_id", "text", "lang", "source",
        F.when(text_doc, "text_extractable").when(i % 3 == 1, "scanned").otherwise("handwritten").alias("category"),
        F.when(~text_doc, (i * 37 % 51 + 50) / 100.0).alias("confidence"),
        F.when(~text_doc, F.when(i % 10 == 0, "not_attempted").when(i % 10 == 1, "malformed_json")
               .when(i % 10 == 2, "ok+cached").otherwise("ok")).alias("status"))


def gold(spark, sf_dir):
    def build(spark, sf_dir):
        def found(pattern):
            return F.regexp_extract_all("text", F.lit(pattern), F.lit(0))

        def typed(values, kind):
            return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

        parts = [typed(found(p), t) for t, p in GOLD_PATTERNS.items()]
        return spread(table(spark, sf_dir, "documents")).select("doc_id", F.inline(F.concat(*parts)))

    return fx.shared(spark, sf_dir, "gold_entities", build)


def predictions(spark, sf_dir):
    """Branch outputs in the shapes real branches give: separators lost, characters misread,
    spurious and missing entities."""
    d = docs(spark, sf_dir).select("doc_id", "category", "status")
    g = gold(spark, sf_dir).join(d, "doc_id")
    i, v, image = F.col("doc_id"), F.col("value"), F.col("category") != "text_extractable"
    ok = image & F.col("status").startswith("ok")

    def rows(df, branch, value, kind=F.col("type")):
        return df.select("doc_id", F.lit(branch).alias("branch"), kind.alias("type"), value.alias("value"))

    text = g.filter(~image & ~((F.col("type") == "PERSON") & (i % 4 == 1)))
    misread = F.when(i % 2 == 0, F.concat(F.expr("left(value, length(value) - 1)"), F.lit("x"))).otherwise(F.lower(v))
    return (rows(text, B1, F.upper(F.regexp_replace(v, "[- ]", "")))
            .union(rows(g.filter(image), B2, misread))
            .union(rows(g.filter(ok), B3, F.concat(F.lit(" "), v)))
            .union(rows(d.filter(ok & (i % 5 == 0)), B3, F.lit("Nobody"), F.lit("PERSON"))))


def counts(spark, sf_dir):
    return fx.shared(spark, sf_dir, "match_counts", lambda s, d: matching.match_exact(
        gold(s, d), predictions(s, d), ["doc_id"], ["branch"], [B1, B2, B3]))


def picked(spark, sf_dir, tau=fv.OCR_TAU):
    d = docs(spark, sf_dir).drop("text")
    return matching.assemble(d, counts(spark, sf_dir), tau)


def prf6(df):
    return df.withColumns({c: fx.rd(c, 6) for c in ("precision", "recall", "f1", "weighted_recall") if c in df.columns})


# --- recognisers --------------------------------------------------------------------
RULE_SQL = {"CREDIT_CARD": r"[0-9]{4}(?:[- ]?[0-9]{4}){3}|\b[0-9]{4}[- ]?[0-9]{6}[- ]?[0-9]{4,5}\b|\b4[0-9]{12}\b", "EMAIL_ADDRESS": GOLD_PATTERNS["EMAIL"],
            "PHONE_NUMBER": r"\+?[0-9]{0,2}[ ]?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\+[0-9]{1,3}[- ]?[0-9]{3}[- ]?[0-9]{7}\b",
            "NID": r"\b[0-9]{5}[- ]?[0-9]{7}[- ]?[0-9]\b", "DATE_TIME": "(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}",
            "PERSON": r"(?:^|\n)Name: [^\n]+", "LOCATION": r"(?:^|\n)Address: [^\n]+",
            "PASSWORD": r"\b[A-Za-z0-9]{8,20}\b"}
LUHN = """(list_sum(list_transform(list_reverse(string_split(digits, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT)
    ELSE CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"""
CONTEXT = {r.recogniser: r.context for r in tx.RULES}
BASE = {r.recogniser: r.score for r in tx.RULES}


def _near(rule):
    return "(" + (" OR ".join(f"contains(before, '{w}')" for w in CONTEXT[rule]) or "false") + ")"


HITS = {
    "pieces": " UNION ALL ".join(f"""SELECT doc_id, text, '{r}' AS recogniser, regexp_extract_all(text, '{p}') AS m,
        string_split_regex(text, '{p}') AS gaps FROM documents""" for r, p in RULE_SQL.items()),
    "placed": """SELECT doc_id, text, recogniser, m[i] AS value, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits,
        CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1],
        lambda x: length(x))), 0) AS INT) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM pieces WHERE len(m) > 0)""",
    "hits": f"""SELECT doc_id, recogniser, value, start, CAST(start + length(value) AS INT) AS "end",
        CASE WHEN recogniser = 'CREDIT_CARD' THEN 1e0 """ + " ".join(
        f"WHEN recogniser = '{r}' AND {_near(r)} THEN least(1e0, {s}e0 + 35e-2) WHEN recogniser = '{r}' THEN {s}e0"
        for r, s in BASE.items() if r != "CREDIT_CARD") + f""" END AS score FROM (SELECT *,
        lower(substr(text, CAST(greatest(start + 1 - 40, 1) AS INT), CAST(least(start, 40) AS INT))) AS before FROM placed)
        WHERE (recogniser <> 'CREDIT_CARD' OR {LUHN}) AND (recogniser <> 'PASSWORD' OR (regexp_matches(value, '[a-z]')
        AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')))""",
    "ordered": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) AS rn FROM hits""",
    "greedy": """SELECT doc_id, rn, [{'s': start, 'e': "end", 'rn': rn}] AS kept FROM ordered WHERE rn = 1 UNION ALL
        SELECT o.doc_id, o.rn, CASE WHEN len(list_filter(g.kept, lambda k: o.start < k.e AND k.s < o."end")) > 0 THEN g.kept
        ELSE list_append(g.kept, {'s': o.start, 'e': o."end", 'rn': o.rn}) END FROM greedy g JOIN ordered o
        ON o.doc_id = g.doc_id AND o.rn = g.rn + 1""",
    "final": """SELECT o.* FROM ordered o JOIN (SELECT doc_id, arg_max(kept, rn) AS kept FROM greedy GROUP BY doc_id) g
        ON g.doc_id = o.doc_id AND len(list_filter(g.kept, lambda k: k.rn = o.rn)) > 0""",
    "tiers": """SELECT documents.doc_id, count(*) FILTER (WHERE recogniser IN ('CREDIT_CARD', 'NID', 'PASSWORD')) AS high_entities,
        count(*) FILTER (WHERE recogniser IN ('EMAIL_ADDRESS', 'PHONE_NUMBER', 'LOCATION')) AS medium_entities,
        count(*) FILTER (WHERE recogniser IN ('PERSON', 'DATE_TIME')) AS low_entities FROM documents LEFT JOIN final USING (doc_id)
        GROUP BY documents.doc_id"""}


@query("recogniser_hits", dsql('SELECT doc_id, recogniser, start, "end", round(score, 6) AS score, value FROM hits', "hits", **HITS))
def recogniser_hits(spark, sf_dir):
    return pii.recognise(spread(table(spark, sf_dir, "documents"))).select(
        "doc_id", "recogniser", "start", "end", r6("score", "score"), "value")


@query("overlap_suppression", dsql('SELECT doc_id, recogniser, start, "end", round(score, 6) AS score, value FROM final', "final", **HITS))
def overlap_suppression(spark, sf_dir):
    hits = pii.recognise(spread(table(spark, sf_dir, "documents")))
    return pii.suppress_overlaps(hits).select("doc_id", "recogniser", "start", "end", r6("score", "score"), "value")


@query("document_scan", dsql("""SELECT *, CASE WHEN sensitivity_score >= 70 THEN 'HIGH-RISK' WHEN sensitivity_score >= 20 THEN
    'SENSITIVE' ELSE 'SAFE' END AS risk_category, CASE WHEN sensitivity_score >= 70 THEN 'BLOCK' WHEN sensitivity_score >= 20 THEN
    'ALERT' ELSE 'PERMIT' END AS action_taken FROM (SELECT *, CAST(least(10 * high_entities + 5 * medium_entities + low_entities, 100) AS INT)
    AS sensitivity_score FROM tiers)""", "tiers", **HITS))
def document_scan(spark, sf_dir):
    return pii.scan_documents(spread(table(spark, sf_dir, "documents")))


@query("tier_counts", dsql("""SELECT doc_id, count(*) FILTER (WHERE type = 'CREDIT_CARD') AS high_entities,
    count(*) FILTER (WHERE type IN ('EMAIL', 'PHONE')) AS medium_entities, count(*) FILTER (WHERE type = 'PERSON') AS low_entities
    FROM gold GROUP BY doc_id""", "gold"))
def tier_counts(spark, sf_dir):
    return pii.tier_counts(gold(spark, sf_dir))


@query("normalised_values", dsql("""SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9@]+', '', 'g')) AS folded_md5,
    md5(regexp_replace(regexp_replace(lang || '/' || text, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug_md5 FROM documents"""))
def normalised_values(spark, sf_dir):
    d = tx.with_normalised(table(spark, sf_dir, "documents"), "text", "folded")
    return d.select("doc_id", F.md5("folded").alias("folded_md5"),
                    F.md5(tx.slug(F.concat("lang", F.lit("/"), "text"))).alias("slug_md5"))


# --- routing ---------------------------------------------------------------------------
@query("cascade_routes", dsql(f"""SELECT doc_id, branch, (branch <> '{B3}' OR coalesce(status LIKE 'ok%', false)) AS executed FROM routed""", "routed"))
def cascade_routes(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("branch", pii.route(F.col("confidence"), F.col("category"), fv.OCR_TAU))
    return d.select("doc_id", "branch", pii.executed(F.col("branch"), F.col("status")).alias("executed"))


@query("routed_counts", dsql(f"""SELECT category, count(*) FILTER (WHERE branch = '{B1}') AS branch1,
    count(*) FILTER (WHERE branch = '{B2}') AS branch2, count(*) FILTER (WHERE branch = '{B3}') AS branch3 FROM routed GROUP BY category""", "routed"))
def routed_counts(spark, sf_dir):
    return matching.routed_counts(docs(spark, sf_dir), fv.OCR_TAU)


@query("cascade_assembly", dsql("""SELECT routed.doc_id, routed.branch, type, value FROM routed LEFT JOIN preds USING (doc_id, branch)""", "routed", "preds"))
def cascade_assembly(spark, sf_dir):
    out = matching.assemble(docs(spark, sf_dir).drop("text"), predictions(spark, sf_dir), fv.OCR_TAU)
    return out.select("doc_id", "branch", "type", "value")


@query("corpus_counts", dsql("""SELECT category, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS gold_entities,
    count(*) FILTER (WHERE n IS NULL) AS pii_free_docs FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM gold GROUP BY doc_id)
    USING (doc_id) GROUP BY category""", "docs", "gold"))
def corpus_counts(spark, sf_dir):
    return matching.corpus_counts(docs(spark, sf_dir), gold(spark, sf_dir))


@query("entities_per_type", dsql("SELECT type, count(*) AS entities, count(DISTINCT doc_id) AS documents FROM gold GROUP BY type", "gold"))
def entities_per_type(spark, sf_dir):
    return gold(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("doc_id").alias("documents"))


@query("mean_confidence", dsql("""SELECT category, round(avg(confidence), 6) AS mean_confidence FROM docs WHERE category <> 'text_extractable'
    GROUP BY category""", "docs"))
def mean_confidence(spark, sf_dir):
    return (docs(spark, sf_dir).filter(F.col("category") != "text_extractable").groupBy("category")
            .agg(r6(F.avg("confidence"), "mean_confidence")))


@query("call_status", dsql("SELECT category, status, count(*) AS calls FROM docs WHERE status IS NOT NULL GROUP BY ALL", "docs"))
def call_status(spark, sf_dir):
    return docs(spark, sf_dir).filter("status is not null").groupBy("category", "status").agg(F.count(F.lit(1)).alias("calls"))


@query("status_coverage", dsql("""SELECT category, count(*) AS images, count(*) FILTER (WHERE status LIKE 'ok%') AS scored FROM docs
    WHERE status IS NOT NULL GROUP BY category""", "docs"))
def status_coverage(spark, sf_dir):
    return matching.status_coverage(docs(spark, sf_dir).filter("status is not null"))


BOXES = """SELECT doc_id, unnest(range(1, len(lines) + 1)) AS box_no, unnest(lines) AS text FROM (
    SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"""


@query("ocr_rollup", dsql("""SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY box_no)) AS transcript_md5,
    round(sum(length(text) * (((box_no * 13 + doc_id) % 50 + 50) / 101e0)) / greatest(sum(length(text)), 1), 6) AS confidence,
    count(*) AS boxes FROM boxes GROUP BY doc_id""", "boxes", boxes=BOXES))
def ocr_rollup(spark, sf_dir):
    boxes = (table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
             .select("doc_id", (F.col("p") + 1).alias("box_no"), "text",
                     (((F.col("p") + 1) * 13 + F.col("doc_id")) % 50 + 50).alias("c"))
             .withColumn("confidence", F.col("c") / 101.0))
    out = pii.ocr_rollup(boxes)
    return out.select("doc_id", F.md5("transcript").alias("transcript_md5"), r6("confidence", "confidence"), "boxes")


# --- matching and cascade evaluation ------------------------------------------------------
@query("exact_matches", dsql("SELECT doc_id, branch, type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM mc", "mc"))
def exact_matches(spark, sf_dir):
    return counts(spark, sf_dir).select("doc_id", "branch", "type", "tp", "fp", "fn")


@query("cascade_micro", dsql(f"SELECT *, {PRF} FROM (SELECT {SUMS} FROM picked)", "picked"))
def cascade_micro(spark, sf_dir):
    return prf6(matching.micro(picked(spark, sf_dir)))


@query("cascade_by_type", dsql(f"SELECT *, {PRF} FROM (SELECT type, {SUMS} FROM picked GROUP BY type) ORDER BY f1 DESC", "picked"))
def cascade_by_type(spark, sf_dir):
    """Entity types, best F1 first."""
    return prf6(matching.micro(picked(spark, sf_dir).filter("type is not null"), ["type"])).orderBy(F.desc("f1"), "type")


def category_sql(source, docs_source="docs"):
    return f"""SELECT category, tp, fp, fn, n_docs, {PRF}, round(CASE WHEN category IS NULL THEN w / n_docs END, 6) AS weighted_recall FROM (
        SELECT category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
        CAST(sum(n) AS BIGINT) AS n_docs, sum(n * CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) AS w FROM (
        SELECT category, {SUMS}, max(n) AS n FROM (SELECT category, count(*) AS n FROM {docs_source} GROUP BY category)
        LEFT JOIN {source} USING (category) GROUP BY category) GROUP BY GROUPING SETS ((category), ()))"""


@query("cascade_by_category", dsql(category_sql("picked"), "picked", "docs"))
def cascade_by_category(spark, sf_dir):
    return prf6(matching.by_category(picked(spark, sf_dir), docs(spark, sf_dir)))


RAN = {"ran": f"SELECT * FROM routed WHERE branch <> '{B3}' OR status LIKE 'ok%'",
       "ranpick": f"SELECT * FROM picked WHERE branch <> '{B3}' OR status LIKE 'ok%'"}


@query("executed_only_by_category", dsql(category_sql("ranpick", "ran"), "ranpick", "ran", **RAN))
def executed_only_by_category(spark, sf_dir):
    ran = pii.executed(F.col("branch"), F.col("status"))
    d = docs(spark, sf_dir).withColumn("branch", pii.route(F.col("confidence"), F.col("category"), fv.OCR_TAU))
    return prf6(matching.by_category(picked(spark, sf_dir).filter(ran), d.filter(ran)))


@query("not_executed", dsql("SELECT (SELECT count(*) FROM docs) - (SELECT count(*) FROM ran) AS n_not_executed", "docs", "ran", **RAN))
def not_executed(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("branch", pii.route(F.col("confidence"), F.col("category"), fv.OCR_TAU))
    return d.agg(F.count_if(~pii.executed(F.col("branch"), F.col("status"))).alias("n_not_executed"))


@query("text_only_baseline", dsql(category_sql("base"), "base", "docs"))
def text_only_baseline(spark, sf_dir):
    return prf6(matching.by_category(text_only(spark, sf_dir), docs(spark, sf_dir)))


def text_only(spark, sf_dir):
    b1 = counts(spark, sf_dir).filter(F.col("branch") == B1).drop("branch")
    return docs(spark, sf_dir).select("doc_id", "category").join(b1, "doc_id")


COVER = f"""SELECT coalesce(c.category, 'overall_weighted') AS category, round_even(coalesce(b.weighted_recall, b.recall), 3) AS base,
    round_even(coalesce(c.weighted_recall, c.recall), 3) AS cascade, round_even(round_even(coalesce(c.weighted_recall, c.recall), 3)
    - round_even(coalesce(b.weighted_recall, b.recall), 3), 3) AS gain FROM ({category_sql('picked')}) c
    JOIN ({category_sql('base')}) b ON c.category IS NOT DISTINCT FROM b.category"""


@query("coverage_table", dsql(COVER, "picked", "base", "docs"))
def coverage_table(spark, sf_dir):
    d = docs(spark, sf_dir)
    return matching.coverage_table(matching.by_category(picked(spark, sf_dir), d),
                                   matching.by_category(text_only(spark, sf_dir), d))


@query("coverage_long", dsql(f"""SELECT category, unnest(['base', 'cascade']) AS system, unnest([base, cascade]) AS coverage FROM ({COVER})
    WHERE category <> 'overall_weighted'""", "picked", "base", "docs"))
def coverage_long(spark, sf_dir):
    return matching.coverage_long(coverage_table(spark, sf_dir))


@query("head_to_head", dsql(f"""SELECT branch, *, {PRF} FROM (SELECT branch AS b, type, {SUMS} FROM docs JOIN mc USING (doc_id)
    WHERE status LIKE 'ok%' AND branch <> '{B1}' GROUP BY ALL) t, (SELECT '{B2}' AS branch UNION ALL SELECT '{B3}') n WHERE n.branch = t.b"""
    .replace("SELECT branch, *,", "SELECT n.branch, type, tp, fp, fn,"), "docs", "mc"))
def head_to_head(spark, sf_dir):
    seen = docs(spark, sf_dir).filter(F.col("status").startswith("ok")).select("doc_id")
    both = counts(spark, sf_dir).filter(F.col("branch") != B1).join(seen, "doc_id", "left_semi")
    return prf6(matching.micro(both, ["branch", "type"]))


@query("confident_counterfactual", dsql(f"""SELECT branch, tp, fp, fn, {PRF} FROM (SELECT branch, {SUMS} FROM docs JOIN mc USING (doc_id)
    WHERE status LIKE 'ok%' AND confidence >= 85e-2 AND branch <> '{B1}' GROUP BY branch)""", "docs", "mc"))
def confident_counterfactual(spark, sf_dir):
    keep = docs(spark, sf_dir).filter(F.col("status").startswith("ok") & (F.col("confidence") >= fv.OCR_TAU)).select("doc_id")
    both = counts(spark, sf_dir).filter(F.col("branch") != B1).join(keep, "doc_id", "left_semi")
    return prf6(matching.micro(both, ["branch"]))


CALIB = """SELECT category, doc_id FROM (SELECT category, doc_id, row_number() OVER (PARTITION BY category ORDER BY md5('1337|' || doc_id), doc_id) AS rn,
    count(*) OVER (PARTITION BY category) AS n FROM docs WHERE category <> 'text_extractable') WHERE rn <= round_even(n * 25e-2, 0)"""


@query("calibration_docs", dsql("SELECT category, doc_id FROM calib", "calib", calib=CALIB))
def calibration_docs(spark, sf_dir):
    d = docs(spark, sf_dir).filter(F.col("category") != "text_extractable")
    return ordering.stratified_sample(d, "doc_id", "category", fv.CALIB_FRACTION, 1337)


@query("evaluation_docs", dsql("SELECT category, count(*) AS docs FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM calib) GROUP BY category",
                               "docs", "calib", calib=CALIB))
def evaluation_docs(spark, sf_dir):
    d = docs(spark, sf_dir).drop("text")
    return (d.join(calibration_docs(spark, sf_dir), "doc_id", "left_anti").groupBy("category").agg(F.count(F.lit(1)).alias("docs")))


SWEEP = f"""SELECT t, round(t / 1e2, 2) AS tau, tp, fp, fn, {PRF} FROM (SELECT t, {SUMS} FROM (SELECT unnest(range(50, 101)) AS t),
    docs JOIN mc USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM calib) AND branch = CASE WHEN confidence >= t / 1e2 THEN '{B2}' ELSE '{B3}' END
    GROUP BY t)"""


@query("ocr_threshold_sweep", dsql(f"SELECT * EXCLUDE (t) FROM ({SWEEP})", "docs", "mc", "calib", calib=CALIB))
def ocr_threshold_sweep(spark, sf_dir):
    return prf6(calib_sweep(spark, sf_dir)).drop("step").withColumn("tau", F.round("tau", 2))


def calib_sweep(spark, sf_dir):
    d = docs(spark, sf_dir).drop("text").join(calibration_docs(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return matching.tau_sweep(d, counts(spark, sf_dir))


@query("best_ocr_threshold", dsql(f"SELECT tau, f1 FROM ({SWEEP}) ORDER BY f1 DESC, t LIMIT 1", "docs", "mc", "calib", calib=CALIB))
def best_ocr_threshold(spark, sf_dir):
    return matching.best_tau(calib_sweep(spark, sf_dir)).select(F.round("tau", 2).alias("tau"), r6("f1", "f1"))


AT_BEST = {"calib": CALIB, "bestt": f"SELECT t / 1e2 AS tau FROM ({SWEEP}) ORDER BY f1 DESC, t LIMIT 1",
    "rbest": f"""SELECT docs.*, CASE WHEN category = 'text_extractable' THEN '{B1}' WHEN confidence >= tau THEN '{B2}' ELSE '{B3}' END AS branch
        FROM docs, bestt""",
    "pbest": "SELECT rbest.*, type, tp, fp, fn FROM rbest JOIN mc USING (doc_id, branch)"}


def evaluation(spark, sf_dir):
    return cascade_evaluation.evaluate(docs(spark, sf_dir).drop("text"), counts(spark, sf_dir))


@query("calibrated_cascade_by_category", dsql(category_sql("pbest"), "pbest", "docs", "mc", **AT_BEST))
def calibrated_cascade_by_category(spark, sf_dir):
    return prf6(evaluation(spark, sf_dir)["calibrated.by_category"])


@query("calibrated_cascade_by_type", dsql(f"SELECT *, {PRF} FROM (SELECT type, {SUMS} FROM pbest GROUP BY type)", "pbest", "mc", **AT_BEST))
def calibrated_cascade_by_type(spark, sf_dir):
    return prf6(evaluation(spark, sf_dir)["calibrated.by_type"])


@query("executed_only_by_type", dsql(f"SELECT *, {PRF} FROM (SELECT type, {SUMS} FROM ranpick GROUP BY type)", "ranpick", **RAN))
def executed_only_by_type(spark, sf_dir):
    return prf6(evaluation(spark, sf_dir)["given.executed_by_type"])


CALLS = {"calls": """SELECT doc_id, category, CASE WHEN doc_id % 4 = 0 THEN 'big' ELSE 'small' END AS model, status,
    (status LIKE 'ok' OR status = 'malformed_json') AS billed_now, CASE WHEN doc_id % 9 <> 0 THEN length(text) END AS prompt_tokens,
    CASE WHEN doc_id % 9 <> 0 THEN doc_id % 100 END AS completion_tokens FROM docs WHERE status IS NOT NULL"""}


@query("call_costs", dsql("""SELECT model, count(*) FILTER (WHERE used) AS calls_billed, count(*) FILTER (WHERE NOT billed_now AND status LIKE 'ok%') AS calls_from_cache,
    CAST(sum(prompt_tokens) FILTER (WHERE used) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) FILTER (WHERE used) AS BIGINT) AS completion_tokens,
    round(sum(prompt_tokens) FILTER (WHERE used) / 1e6 * CASE model WHEN 'big' THEN 2e0 ELSE 5e-1 END
    + sum(completion_tokens) FILTER (WHERE used) / 1e6 * CASE model WHEN 'big' THEN 6e0 ELSE 1e0 END, 6) AS cost
    FROM (SELECT *, billed_now AND prompt_tokens IS NOT NULL AS used FROM calls) GROUP BY model""", "calls", **CALLS))
def call_costs(spark, sf_dir):
    i = F.col("doc_id")
    calls = docs(spark, sf_dir).filter("status is not null").select(
        "doc_id", F.when(i % 4 == 0, "big").otherwise("small").alias("model"), "status",
        F.col("status").isin("ok", "malformed_json").alias("billed_now"),
        F.when(i % 9 != 0, F.length("text")).alias("prompt_tokens"), F.when(i % 9 != 0, i % 100).alias("completion_tokens"))
    prices = calls.select("model").distinct().withColumns({
        "input_per_m": F.when(F.col("model") == "big", 2.0).otherwise(0.5),
        "output_per_m": F.when(F.col("model") == "big", 6.0).otherwise(1.0)})
    return matching.cost_report(calls, prices).select("model", "calls_billed", "calls_from_cache", "prompt_tokens",
                                                      "completion_tokens", r6("cost", "cost"))


INTER = """SELECT category, doc_id, rn, CASE WHEN rn <= m THEN rn * 2 - CASE WHEN category = 'scanned' THEN 1 ELSE 0 END ELSE rn + m END AS call_order
    FROM (SELECT category, doc_id, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS rn FROM docs WHERE category <> 'text_extractable'),
    (SELECT least(count(*) FILTER (WHERE category = 'scanned'), count(*) FILTER (WHERE category = 'handwritten')) AS m FROM docs)"""


def call_order(spark, sf_dir):
    return ordering.interleave(docs(spark, sf_dir), "category", "scanned", "handwritten", "doc_id")


@query("interleaved_calls", dsql("SELECT category, doc_id, rn, call_order FROM inter", "inter", inter=INTER))
def interleaved_calls(spark, sf_dir):
    return call_order(spark, sf_dir)


@query("pending_calls", dsql("""SELECT doc_id, call_order FROM inter WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE status LIKE 'ok%')
    ORDER BY call_order LIMIT 50""", "inter", "docs", inter=INTER))
def pending_calls(spark, sf_dir):
    d = docs(spark, sf_dir)
    return matching.pending_calls(call_order(spark, sf_dir), d.filter("status is not null"), "call_order", 50).select("doc_id", "call_order")


@query("scan_rows", dsql("""SELECT printf('PII-%04d', position) AS scan_id, category, branch AS branch_used,
    CASE WHEN confidence IS NULL THEN 'N/A' ELSE CAST(confidence AS VARCHAR) END AS ocr_confidence, h AS high_entities, m AS medium_entities, l AS low_entities,
    CAST(least(10 * h + 5 * m + l, 100) AS INT) AS sensitivity_score, CAST(least(10 * bh + 5 * bm + bl, 100) AS INT) AS base_system_score,
    CASE WHEN category <> 'text_extractable' THEN 'SAFE (blind to image)' WHEN 10 * bh + 5 * bm + bl >= 70 THEN 'HIGH-RISK'
        WHEN 10 * bh + 5 * bm + bl >= 20 THEN 'SENSITIVE' ELSE 'SAFE' END AS base_system_label,
    CASE WHEN branch LIKE 'Branch1%' THEN 10e0 WHEN branch LIKE 'Branch2%' THEN 200e0 ELSE 500e0 END AS processing_ms,
    CASE WHEN 10 * h + 5 * m + l >= 70 THEN 'BLOCK' WHEN 10 * h + 5 * m + l >= 20 THEN 'ALERT' ELSE 'PERMIT' END AS action_taken,
    10 * h + 5 * m + l >= 20 AS slack_alert_sent, 10 * h + 5 * m + l >= 70 AS jira_ticket_created
    FROM (SELECT routed.*, row_number() OVER (ORDER BY routed.doc_id) AS position FROM routed) r,
    LATERAL (SELECT count(*) FILTER (WHERE type = 'CREDIT_CARD') AS h, count(*) FILTER (WHERE type IN ('EMAIL', 'PHONE')) AS m,
        count(*) FILTER (WHERE type = 'PERSON') AS l FROM preds p WHERE p.doc_id = r.doc_id AND p.branch = r.branch),
    LATERAL (SELECT count(*) FILTER (WHERE type = 'CREDIT_CARD') AS bh, count(*) FILTER (WHERE type IN ('EMAIL', 'PHONE')) AS bm,
        count(*) FILTER (WHERE type = 'PERSON') AS bl FROM preds p WHERE p.doc_id = r.doc_id AND p.branch LIKE 'Branch1%')""", "routed", "preds"))
def scan_rows(spark, sf_dir):
    d = docs(spark, sf_dir).drop("text").withColumn("branch", pii.route(F.col("confidence"), F.col("category"), fv.OCR_TAU))
    nested = predictions(spark, sf_dir).groupBy("doc_id", "branch").agg(F.collect_list(F.struct("type", "value")).alias("entities"))
    base = nested.filter(F.col("branch") == B1).select("doc_id", F.col("entities").alias("text_entities"))
    routed = (d.join(nested, ["doc_id", "branch"], "left").join(base, "doc_id", "left")
              .join(ordering.positions(d, ["doc_id"]).select("doc_id", "position"), "doc_id"))
    empty = F.expr(f"cast(array() as {matching.ENTITY_LIST})")
    filled = routed.withColumns({
        "entities": F.coalesce("entities", empty), "text_entities": F.coalesce("text_entities", empty),
        "b1_ms": F.lit(10.0), "b2_ms": F.lit(200.0), "b3_ms": F.lit(300.0), "timestamp": F.lit(None).cast("timestamp"),
        **{c: F.lit("-") for c in ("user_id", "user_name", "department", "platform", "file_name")}})
    out = pii.scan_rows(filled)
    kinds = {v: k for k, v in fv.CATEGORY_FILE_TYPE.items()}
    return out.withColumn("category", scores.lookup("file_type", kinds)).select(
        "scan_id", "category", "branch_used", "ocr_confidence", "high_entities", "medium_entities", "low_entities",
        "sensitivity_score", "base_system_score", "base_system_label", "processing_ms", "action_taken", "slack_alert_sent",
        "jira_ticket_created")


@query("renested_entities", dsql("""SELECT doc_id, count(*) AS n, list(type || '=' || value ORDER BY type, value)[1] AS first_entity
    FROM gold GROUP BY doc_id""", "gold"))
def renested_entities(spark, sf_dir):
    """Explode and re-nest entity lists."""
    nested = gold(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("e"))
    back = nested.select("doc_id", F.inline("e")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("type", "value")).alias("m"))
    return back.select("doc_id", "n", F.concat("m.type", F.lit("="), "m.value").alias("first_entity"))


# --- fuzzy matching (Python) ------------------------------------------------------------
@query("fuzzy_cascade_by_category")
def fuzzy_cascade_by_category(spark, sf_dir):
    g = gold(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("gold"))
    d = docs(spark, sf_dir).drop("text")
    p = (matching.assemble(d, predictions(spark, sf_dir), fv.OCR_TAU).filter("type is not null").groupBy("doc_id")
         .agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("pred")))
    both = d.join(g, "doc_id", "left").join(p, "doc_id", "left")
    out = matching.match_fuzzy(both).join(d.select("doc_id", "category"), "doc_id")
    return prf6(matching.by_category(out, d))


# --- model replies -------------------------------------------------------------------------
REPLY_SQL = {"replies": """SELECT gold.doc_id, string_agg('{"type": "' || lower(type) || '", "value": " ' || value || ' "}', ', ' ORDER BY type, value) AS items,
    count(*) AS n FROM gold GROUP BY gold.doc_id"""}


@query("reply_entities", dsql("""SELECT doc_id, CASE WHEN doc_id % 6 = 4 THEN NULL WHEN doc_id % 6 = 5 THEN 0 ELSE n END AS entities,
    doc_id % 6 <> 4 AS parsed FROM replies""", "replies", **REPLY_SQL))
def reply_entities(spark, sf_dir):
    """Fenced, bare, wrapped, chatty, broken and blank replies built from each document's entities."""
    items = gold(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("type", "value"))),
        lambda e: F.concat(F.lit('{"type": "'), F.lower(e["type"]), F.lit('", "value": " '), e["value"], F.lit(' "}'))), ", ").alias("items"))
    i, body = F.col("doc_id") % 6, F.concat(F.lit("["), F.col("items"), F.lit("]"))
    reply = (F.when(i == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i == 1, body)
             .when(i == 2, F.concat(F.lit('{"entities": '), body, F.lit("}")))
             .when(i == 3, F.concat(F.lit("Here you go: "), body, F.lit(" done"))).when(i == 4, F.lit("no json here")).otherwise(F.lit("  ")))
    parsed = items.select("doc_id", tx.reply_entities(reply).alias("r"))
    return parsed.select("doc_id", F.when(F.col("r").isNotNull(), F.size(tx.clean_entities(F.col("r")))).alias("entities"),
                         F.col("r").isNotNull().alias("parsed"))


# --- vectors --------------------------------------------------------------------------------
@query("memory_bank_scores", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label
        ORDER BY md5('42|' || vec_id), vec_id) AS pick FROM embeddings),
    c AS (SELECT q.vec_id, q.label, list_cosine_similarity(q.e, b.e) AS cos FROM v q JOIN v b ON q.label = b.label AND b.pick <= 256),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC) AS rn FROM c)
    SELECT vec_id, label, round(1e0 - avg(cos), 6) AS raw FROM k WHERE rn <= 10 GROUP BY vec_id, label""")
def memory_bank_scores(spark, sf_dir):
    """Every vector against its label's bank; a bank member may be its own neighbour."""
    e = table(spark, sf_dir, "embeddings")
    bank = ordering.capped_sample(e, ["vec_id"], ["label"], fv.MEMORY_BANK_CAP, 42)
    out = scoring.memory_bank_scores(e, bank, "label", "embedding", ["vec_id"])
    return out.select("vec_id", "label", r6("raw", "raw"))


@query("unit_vectors", """SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS length, round(u[1], 6) AS first_value
    FROM (SELECT vec_id, list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-9)) AS u
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")
def unit_vectors(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").withColumn("u", vectors.unit(F.col("embedding")))
    return u.select("vec_id", r6(vectors.norm(F.col("u")), "length"), r6(F.col("u")[0], "first_value"))
