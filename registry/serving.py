"""Encoder, forest and event scores with model tables made by rules, so that SQL can say the same."""

from __future__ import annotations

import dataclasses
import uuid

import numpy as np
from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.functions import vectors
from driftwarden.operators import events as ev, forest, frequent, scoring, sessions
from driftwarden.plans import event_scoring, session_training
from driftwarden.session import hash_spread, shared_dir, stage_table
from driftwarden.streaming import jobs
from registry import Book, event_docs, fixtures as fx
from registry.behaviour import VEC_SQL
from registry.fixtures import r6

book = Book()
query = book.query
HIDDEN, TREES, WIDTH = 3, 8, len(fv.FEATURES)


# --- encoder ------------------------------------------------------------------------------------
def ruled_weights():
    r, c = np.arange(4 * HIDDEN)[:, None], np.arange(WIDTH)[None, :]
    s = np.arange(HIDDEN)[None, :]
    return {"input": ((7 * r + 3 * c) % 11 - 5) / 20.0, "state": ((5 * r + 2 * s) % 7 - 3) / 10.0, "bias": (r[:, 0] % 5 - 2) / 20.0}


def _encode_sql(window):
    """The last hidden state of a window: a fold over its vectors with hidden and cell state side by side."""
    matrix = {n: "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in np.atleast_2d(m).tolist()) + "]"
              for n, m in ruled_weights().items()}
    gates = (f"list_transform(range(1, {4 * HIDDEN + 1}), lambda r: {matrix['bias']}[1][r] + list_inner_product({matrix['input']}[r], x) "
             f"+ list_inner_product({matrix['state']}[r], acc[1:{HIDDEN}]))")

    def gate(n):
        return f"g[{n * HIDDEN} + i]"

    def sigmoid(v):
        return f"(1e0 / (1e0 + exp(-{v})))"

    cell = (f"list_transform(range(1, {HIDDEN + 1}), lambda i: {sigmoid(gate(1))} * acc[{HIDDEN} + i] "
            f"+ {sigmoid(gate(0))} * tanh({gate(2)}))")
    state = f"list_concat(list_transform(range(1, {HIDDEN + 1}), lambda i: {sigmoid(gate(3))} * tanh(c[i])), c)"
    step = f"list_transform([{gates}], lambda g: list_transform([{cell}], lambda c: {state})[1])[1]"
    zero = "[" + ", ".join(["0e0"] * (2 * HIDDEN)) + "]"
    return f"list_reduce(list_concat([{zero}], {window}), lambda acc, x: {step})[1:{HIDDEN}]"


@query("encoded_by_rule", fx.sql(f"""SELECT user_id, hour_index, round(e[1], 6) AS e_0, round(e[2], 6) AS e_1, round(e[3], 6) AS e_2
    FROM (SELECT user_id, hour_index, {_encode_sql('w')} AS e FROM (SELECT *, list(vec) OVER (PARTITION BY user_id ORDER BY hour_index
    ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS w FROM vecs) WHERE len(w) = 24 AND active)""", "vecs", extra=VEC_SQL))
def encoded_by_rule(spark, sf_dir):
    """LSTM encoding of every scoreable window, with weights read from a table."""
    weights = scoring.encoder_weights(scoring.weight_table(spark, ruled_weights()))
    w = sessions.history_windows(fx.z_frame(spark, sf_dir)).filter("active").select("user_id", "hour_index", "window")
    out = scoring.encode_windows(w, "window", weights)
    return out.select("user_id", "hour_index", *[r6(F.col("encoded")[i], f"e_{i}") for i in range(HIDDEN)])


# --- forest -------------------------------------------------------------------------------------
def ruled_forest(spark):
    """Trees of two levels; tree t splits on feature t % 6, then on the next one."""
    rows = [(t, 16, [t % WIDTH, (t + 1) % WIDTH, (t + 1) % WIDTH, -1, -1, -1, -1], [(t - 3) / 4.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0],
             [1, 3, 5, 3, 4, 5, 6], [2, 4, 6, 3, 4, 5, 6], [0.0, 0.0, 0.0, *[2.0 + ((t + leaf) % 4) for leaf in range(4)]])
            for t in range(TREES)]
    return spark.createDataFrame(rows, forest.TREE)


def _forest_sql(g):
    """Score of the list `g` of six scaled features."""
    paths = [f"(2e0 + ({t} + CASE WHEN {g}[{t % WIDTH + 1}] <= {(t - 3) / 4.0!r}::DOUBLE THEN CASE WHEN {g}[{(t + 1) % WIDTH + 1}] <= 0e0 THEN 0 ELSE 1 END "
             f"ELSE CASE WHEN {g}[{(t + 1) % WIDTH + 1}] <= 5e-1 THEN 2 ELSE 3 END END) % 4)" for t in range(TREES)]
    return f"pow(2e0, -(({' + '.join(paths)}) / {float(TREES)!r}::DOUBLE) / (2e0 * (ln(15e0) + {forest.EULER!r}::DOUBLE) - 30e0 / 16e0))"


@query("isolation_by_rule", fx.sql(f"SELECT user_id, hour_index, round({_forest_sql('g')}, 6) AS raw_if FROM (SELECT user_id, hour_index, ["
       + ", ".join(f"({c} - mu_{i}) / CASE WHEN sd_{i} = 0 THEN 1 ELSE sd_{i} END" for i, c in enumerate(fv.FEATURES))
       + "] AS g FROM afeat, ascal)", "afeat", "ascal"))
def isolation_by_rule(spark, sf_dir):
    """Every active session scored by a stored forest."""
    f = fx.features(spark, sf_dir)
    live = sessions.global_frame(f, sessions.global_scaler(f), f.filter("active"))
    out = forest.forest_score(live.select("user_id", "hour_index", *session_training.SCALED), ruled_forest(spark), session_training.SCALED)
    return out.select("user_id", "hour_index", r6("raw_if", "raw_if"))


# --- whole event score ----------------------------------------------------------------------------
def ruled_model(spark, sf_dir, encoded: bool):
    """Users with u % 7 = 0 are unknown, of the others those with u % 4 = 1 have no bank."""
    users = hash_spread(fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct().filter("u % 7 <> 0"), "u")
    u, name = F.col("u"), F.format_string("USR%03d", "u").alias("user_id")
    stats = users.select(name, *[((u % 5) * 0.1 + i * 0.05).alias(f"mu_{i}") for i in range(WIDTH)],
                         *[(((u + i) % 4) * 0.1 + 0.2).alias(f"sd_{i}") for i in range(WIDTH)])
    size = HIDDEN if encoded else fv.SEQ_LEN * WIDTH
    rows = users.filter("u % 4 <> 1").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), u % 13)))
    codes = rows.select(name, F.col("j").alias("hour_index"), F.transform(
        F.sequence(F.lit(1), F.lit(size)), lambda t: F.sin((u + F.col("j") * 3 + t).cast("double"))).alias("code"))
    scaler = spark.range(1).select(*[F.lit(0.25 * i).alias(f"mu_{i}") for i in range(WIDTH)],
                                   *[F.lit(0.0 if i == WIDTH - 1 else 0.5).alias(f"sd_{i}") for i in range(WIDTH)])
    calibrators = spark.createDataFrame([("bank", 0.2, 1.4), ("forest", 0.3, 0.7)], "name string, lo double, hi double")
    params = spark.range(1).select(F.lit(0.4).alias("alpha"), F.lit(0.5).alias("tau_hybrid"), F.lit(2.5).alias("tau_ewma"))
    tails = codes.select("user_id", "hour_index", F.slice(vectors.unit(F.col("code")), -WIDTH, WIDTH).alias("tail"))
    return event_scoring.ServingModel(stats, scaler, tails, ruled_forest(spark), calibrators, params, codes,
                                      scoring.weight_table(spark, ruled_weights()) if encoded else None)


def earlier_hours(spark, sf_dir):
    """Two thirds of the events have one to five earlier hours, and one that is too old to count."""
    e = fx.table(spark, sf_dir, "events").select("event_id").filter("event_id % 3 <> 0")
    hours = F.concat(F.sequence(F.lit(1).cast("long"), F.col("event_id") % 5 + 1), F.array(F.lit(30).cast("long")))
    rows = e.withColumn("hours_before", F.explode(hours))
    return rows.select(F.format_string("EVT-%08d", "event_id").alias("event_id"), "hours_before",
                       *[(((F.col("event_id") + F.col("hours_before") * i) % 7) / 10.0).alias(c) for i, c in enumerate(fv.SERVING_FEATURES)])


def _scores_sql(encoded: bool, history: bool = True):
    code = _encode_sql("w") if encoded else "flatten(w)"
    size = HIDDEN if encoded else fv.SEQ_LEN * WIDTH
    x = [f"round_even(f.{c} * 1e4, 0) / 1e4" for c in fv.SERVING_FEATURES[:5]] + ["round_even(coalesce(s.mu, g.mu)[6] * 1e4, 0) / 1e4"]

    def z(i, value):
        return f"greatest(-8e0, least(8e0, ({value} - mu[{i}]) / sd[{i}]))"

    past = ", ".join(z(i + 1, f"(((eid + t * {i}) % 7) / 1e1)") for i in range(WIDTH))
    now = ", ".join(z(i + 1, f"x[{i + 1}]") for i in range(WIDTH))
    scaled = ", ".join(f"(x[{i + 1}] - {0.25 * i!r}::DOUBLE) / {1.0 if i == WIDTH - 1 else 0.5!r}::DOUBLE" for i in range(WIDTH))
    users = "SELECT DISTINCT user_id AS u FROM act WHERE user_id % 7 <> 0"
    return event_docs.esql_with("""SELECT event_id, score AS sensitivity_score, round_even(a_lstm * 1e4, 0) / 1e4 AS lstm_score,
            round_even(a_if * 1e4, 0) / 1e4 AS isolation_forest_score, a AS hybrid_anomaly_score, hybrid >= 5e-1 AS hybrid_flagged,
            round_even(least(100, greatest(0, score)) * (1e0 + 25e-1 * a) / 1e2 * 1e4, 0) / 1e4 AS sbrs_value
            FROM (SELECT *, round_even(hybrid * 1e4, 0) / 1e4 AS a FROM (
                SELECT *, greatest(0e0, least(1e0, 4e-1 * a_lstm + (1e0 - 4e-1) * a_if)) AS hybrid FROM srate))""", {
        "sstat": "SELECT printf('USR%03d', u) AS user_id, [" + ", ".join(f"(u % 5) * 1e-1 + {i * 0.05!r}::DOUBLE" for i in range(WIDTH)) + "] AS mu, ["
                 + ", ".join(f"((u + {i}) % 4) * 1e-1 + 2e-1" for i in range(WIDTH)) + f"] AS sd FROM ({users})",
        "gstat": "SELECT [" + ", ".join(f"avg(mu[{i + 1}])" for i in range(WIDTH)) + "] AS mu, ["
                 + ", ".join(f"avg(sd[{i + 1}])" for i in range(WIDTH)) + "] AS sd FROM sstat",
        "scode": f"""SELECT printf('USR%03d', u) AS user_id, j AS hour_index, list_transform(range(1, {size + 1}), lambda t: sin(CAST(u + j * 3 + t AS DOUBLE))) AS code
            FROM (SELECT u, unnest(range(0, u % 13 + 1)) AS j FROM ({users}) WHERE u % 4 <> 1)""",
        "sbank": """SELECT user_id AS owner, code FROM scode UNION ALL SELECT 'all' AS owner, code FROM (SELECT *, row_number() OVER (
            ORDER BY md5('0|' || user_id || '|' || hour_index)) AS pick FROM scode) WHERE pick <= 512""",
        "sevent": f"""SELECT f.event_id, CAST(substr(f.event_id, 5) AS BIGINT) AS eid, CASE WHEN s.mu IS NULL THEN 'all' ELSE e.user_id END AS owner, e.score,
            coalesce(s.mu, g.mu) AS mu, coalesce(s.sd, g.sd) AS sd, [{', '.join(x)}] AS x
            FROM evf f JOIN scan e USING (event_id) LEFT JOIN sstat s ON s.user_id = e.user_id, gstat g""",
        "swin": f"""SELECT *, list_concat(list_transform(range(23, 0, -1), lambda t: CASE WHEN {str(history).lower()} AND eid % 3 <> 0 AND t <= eid % 5 + 1 THEN [{past}]
            ELSE [{', '.join(['0e0'] * WIDTH)}] END), [[{now}]]) AS w, [{scaled}] AS g FROM sevent""",
        "scodes": f"SELECT event_id, owner, {code} AS code FROM swin",
        "snear": """SELECT event_id, 1e0 - avg(cos) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY cos DESC) AS rn FROM (
            SELECT c.event_id, list_cosine_similarity(c.code, b.code) AS cos FROM scodes c JOIN sbank b ON b.owner = c.owner)) WHERE rn <= 10 GROUP BY event_id""",
        "srate": f"""SELECT event_id, score, greatest(0e0, least(1e0, (coalesce(raw, 0e0) - 2e-1) / (14e-1 - 2e-1))) AS a_lstm,
            greatest(0e0, least(1e0, ({_forest_sql('g')} - 3e-1) / (7e-1 - 3e-1))) AS a_if FROM swin LEFT JOIN snear USING (event_id)""",
    }, "srate")


REPORTED = ("event.event_id", "pii.sensitivity_score", "anomaly.lstm_score", "anomaly.isolation_forest_score",
            "anomaly.hybrid_anomaly_score", "anomaly.hybrid_flagged", "sbrs.sbrs_value")


def ruled_scores(spark, sf_dir, encoded: bool):
    events, sketched = frequent.stage_with_sketches(event_docs.documents(spark, sf_dir), "events", ["request.user_id"])
    out = event_scoring.score_events(events, ruled_model(spark, sf_dir, encoded), event_docs.baselines(spark, sf_dir),
                                     history=earlier_hours(spark, sf_dir), sketched=sketched)
    return out.select(*REPORTED)


@query("event_scores_with_history", _scores_sql(encoded=False))
def event_scores_with_history(spark, sf_dir):
    """Events scored end to end, windows filled from earlier hours and flattened."""
    return ruled_scores(spark, sf_dir, encoded=False)


@query("event_scores_with_encoder", _scores_sql(encoded=True))
def event_scores_with_encoder(spark, sf_dir):
    """The same with windows encoded by the stored LSTM."""
    return ruled_scores(spark, sf_dir, encoded=True)


@query("streamed_event_scores", _scores_sql(encoded=False, history=False))
def streamed_event_scores(spark, sf_dir):
    """A stream of event documents in three deliveries, scored against stored model tables."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = event_docs.documents(spark, sf_dir)
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)      # of a delivery
    docs.repartition(3 * files, "event_id").write.parquet(f"{root}/events")
    model = ruled_model(spark, sf_dir, encoded=False)
    stored = {f.name: stage_table(t, f.name) for f in dataclasses.fields(model) if (t := getattr(model, f.name)) is not None}
    homes = stage_table(ev.home_of_users(spark.read.schema(docs.schema).parquet(f"{root}/events")), "homes")
    baselines = stage_table(event_docs.baselines(spark, sf_dir), "baselines")
    events = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/events")
    jobs.score_with_model(events, event_scoring.ServingModel(**stored), baselines, homes,
                          f"{root}/scores", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/scores/query=*/batch=*").select(*REPORTED)
