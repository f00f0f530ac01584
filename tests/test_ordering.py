import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwarden.operators import ewma, joins, ordering, reports, tuning


def frame(spark, n=3000, seed=1, hot=0.35):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=n), 2)
    v[rng.random(n) < hot] = 0.0                       # one value holds a third of all rows
    return pd.DataFrame({"id": np.arange(n), "g": rng.choice(["a", "b", "c"], n, p=[.7, .2, .1]), "v": v,
                         "y": rng.random(n) < 0.2})


@pytest.fixture(scope="module")
def pdf(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).repartition(5)


def test_quantiles_match_numpy(df, pdf):
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p995": 0.995, "p100": 1.0}
    whole = ordering.quantiles(df, "v", probs, ranges=16).first()
    for n, q in probs.items():
        assert whole[n] == pytest.approx(np.percentile(pdf.v, q * 100), abs=1e-12)
    for r in ordering.quantiles(df, "v", probs, ["g"]).collect():
        for n, q in probs.items():
            assert r[n] == pytest.approx(np.percentile(pdf.v[pdf.g == r.g], q * 100), abs=1e-12)


def test_ranks_and_auc(df, pdf):
    want = pd.Series(pdf.v).rank().groupby(pdf.v).first()
    got = {r.v: r.avg_rank for r in ordering.average_ranks(df, "v").collect()}
    assert got == pytest.approx(want.to_dict())
    r = pdf.v.rank()
    p, n = pdf.y.sum(), (~pdf.y).sum()
    auc = (r[pdf.y].sum() - p * (p + 1) / 2) / (p * n)
    assert ordering.rank_auc(df, "v", "y").first().auc == pytest.approx(auc)
    flipped = ordering.rank_auc(df.withColumn("v", -F.col("v")), "v", "y").first().auc
    assert flipped == pytest.approx(1 - auc)
    assert np.isnan(ordering.rank_auc(df.filter("y"), "v", "y").first().auc)


def test_positions_and_interleave(spark, df, pdf):
    got = {r.id: r.position for r in ordering.positions(df, ["v", "id"]).collect()}
    want = pdf.sort_values(["v", "id"]).id.tolist()
    assert [got[i] for i in want] == list(range(1, len(pdf) + 1))
    order = ordering.interleave(df.filter("g <> 'c'"), "g", "a", "b", "id").orderBy("call_order").collect()
    a, b = sorted(pdf.id[pdf.g == "a"]), sorted(pdf.id[pdf.g == "b"])
    k = min(len(a), len(b))
    assert [r.id for r in order] == [x for pair in zip(a, b) for x in pair] + a[k:] + b[k:]


def test_samples(df, pdf):
    cap = ordering.capped_sample(df, ["id"], ["g"], 50, 3)
    assert {r.g: r["count"] for r in cap.groupBy("g").count().collect()} == {"a": 50, "b": 50, "c": 50}
    again = ordering.capped_sample(df.repartition(3), ["id"], ["g"], 50, 3)
    assert {r.id for r in cap.collect()} == {r.id for r in again.collect()}
    share = ordering.stratified_sample(df, "id", "g", 0.25, 9).groupBy("g").count().collect()
    sizes = pdf.g.value_counts()
    assert {r.g: r["count"] for r in share} == {g: int(np.rint(n * 0.25)) for g, n in sizes.items()}


def test_running_totals_reads_input_once(df):
    q = ordering.rank_auc(df, "v", "y", ["g"])
    q.collect()
    assert q._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2


def test_lookup_join_splits_hot_key(spark):
    facts = spark.range(2000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"))
    dim = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"), F.lit("n").alias("n"))
    got = joins.lookup_join(facts, dim, "k", share=0.05)
    want = facts.join(dim, "k", "left").select("row", "k", "x", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert [r.k for r in joins.heavy_keys(facts, "k", 0.05).collect()] == [0]


def test_modal_value_prefers_first_seen(spark):
    df = spark.createDataFrame([("u", "b", 1), ("u", "a", 2), ("u", "a", 3), ("u", "b", 4), ("w", "z", 9), (None, "q", 1)],
                               "user string, city string, pos int")
    assert {(r.user, r.city, r.n) for r in joins.modal_value(df, "user", "city", "pos").collect()} == {("u", "b", 2), ("w", "z", 1)}


def reference_ewma(x, lam):
    state, out = x[0], [(x[0], x[0], 0.0)]
    for v in x[1:]:
        new = lam * v + (1 - lam) * state
        out.append((state, new, (v - state) / max(state, 1e-6)))
        state = new
    return out


@pytest.mark.parametrize("block", [3, 64, 10_000])
def test_ewma_blocks_carry_state(spark, block):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for u in range(4):
        hours = np.sort(rng.choice(400, 90, replace=False))
        x = np.round(rng.gamma(2, 5, 90), 2)
        rows += [(u, int(h), float(v), f"tag{h}") for h, v in zip(hours, x)]
        want.update({(u, int(h)): w for h, w in zip(hours, reference_ewma(x, 0.3))})
    df = spark.createDataFrame(rows, "user_id int, hour_index bigint, x double, tag string").repartition(3)
    got = ewma.ewma_stream(df, "x", block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.ewma_previous, r.ewma_new, r.ewma_deviation) == pytest.approx(want[r.user_id, r.hour_index], rel=1e-9)
        assert r.tag == f"tag{r.hour_index}"


def test_sweep_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame({"a_lstm": rng.random(n).clip(.1, .9).round(2), "a_if": rng.random(n).round(2), "is_true_threat": rng.random(n) < .3})
    pdf["threat_class"] = np.where(pdf.is_true_threat & (rng.random(n) < .5), "malicious_insider", None)
    df = spark.createDataFrame(pdf)
    sweep = {(round(r.alpha, 2), round(r.tau, 2)): r for r in tuning.hybrid_sweep(df, "malicious_insider").collect()}
    assert len(sweep) == 21 * 97
    best, y = (-1.0, None, None), pdf.is_true_threat.to_numpy()
    for i in range(21):
        a = i * 5 / 100
        fused = a * pdf.a_lstm.to_numpy() + (1 - a) * pdf.a_if.to_numpy()
        for t in range(2, 99):
            p = fused >= t / 100
            r = sweep[round(a, 2), round(t / 100, 2)]
            assert (r.tp, r.fp) == ((p & y).sum(), (p & ~y).sum())
            if r.f1 > best[0]:
                best = (r.f1, a, t / 100)
    got = tuning.tune_hybrid(df).first()
    assert (got.f1, got.alpha, got.tau) == pytest.approx(best)


def test_tuning_defaults_on_empty_split(spark):
    empty = spark.createDataFrame([], "a_lstm double, a_if double, is_true_threat boolean, threat_class string, ewma_deviation double")
    assert tuning.tune_hybrid(empty).collect() == [] or tuning.tune_hybrid(empty).first().alpha == 0.5


def test_confusion_blocks_reproduce_published_rates(spark):
    rows = [("ewma", 14, 131, 82, 2125, .09655172413793103, .14583333333333334, .11618257261410789, .05806737588652482),
            ("hybrid", 44, 0, 52, 2256, 1.0, .4583333333333333, .6285714285714286, 0.0),
            ("none", 0, 0, 5, 9, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "d string, tp bigint, fp bigint, fn bigint, tn bigint, p double, r double, f double, q double")
    for r in reports.with_rates(df).collect():
        assert (r.precision, r.recall, r.f1, r.fpr) == pytest.approx((r.p, r.r, r.f, r.q))


def test_knee_picks_published_beta(spark):
    curve = [(0.0, .6934498576056001), (0.5, .7841387856257744), (1.0, .8156699058675189), (1.5, .8239353029413683), (2.0, .8293658557794734),
             (2.5, .8326876671231983), (3.0, .8349529337594296), (12.0, .8389878040826975), (20.0, .8378399530424574)]
    assert tuning.knee(spark.createDataFrame(curve, "beta double, auc double")).first().beta == 2.5


def test_ewma_rows_without_key_or_value(spark):
    rows = [(1, 0, None, "a"), (1, 1, 4.0, "b"), (1, 2, None, "c"), (1, 5, 8.0, "d"), (None, 1, 2.0, "e"), (2, 3, None, "f")]
    df = spark.createDataFrame(rows, "user_id int, hour_index bigint, x double, tag string")
    got = {r.tag: (r.ewma_previous, r.ewma_new, r.ewma_deviation) for r in ewma.ewma_stream(df, "x", block=2).collect()}
    none = (None, None, None)
    assert got == {"a": none, "b": (4.0, pytest.approx(4.0), 0.0), "c": none, "d": (pytest.approx(4.0), pytest.approx(5.2), pytest.approx(1.0)),
                   "f": none}
    assert ewma.steps(df, "x").columns == ["user_id", "hour_index", "x", *ewma.ADDED] and ewma.steps(df, "x").count() == 2


def test_ewma_of_a_key_with_100000_blocks(spark):
    """One row per block: three tiers of nodes; other keys beside it, negative and far steps too."""
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2, 5, 100_000), 2)
    df = spark.createDataFrame(pd.DataFrame({"user_id": 1, "hour_index": np.arange(100_000), "x": x}), "user_id int, hour_index bigint, x double")
    few = spark.createDataFrame([(2, -7, 3.0), (2, 1 << 40, 5.0), (2, -600, 1.0)], "user_id int, hour_index bigint, x double")
    out = ewma.steps(df.union(few), "x", block=1, fan=64, levels=2)
    got = out.filter("user_id = 1").orderBy("hour_index").toPandas()
    want = np.array(reference_ewma(x.tolist(), 0.3))
    assert np.allclose(got[list(ewma.ADDED)].to_numpy(), want, rtol=1e-9)
    assert [r.ewma_new for r in out.filter("user_id = 2").orderBy("hour_index").collect()] == pytest.approx([1.0, 1.6, 2.62])


def test_ewma_moves_only_key_step_and_value(spark, tmp_path):
    """Nothing but narrow columns is shuffled for the scan, and there is no window over a key."""
    df = spark.range(5000).select((F.col("id") % 50).alias("user_id"), F.col("id").alias("hour_index"), F.rand(1).alias("x"), F.lit("wide").alias("tag"))
    df.write.parquet(str(tmp_path / "t"))
    text = ewma.steps(spark.read.parquet(str(tmp_path / "t")), "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "tag" not in text and "Window" not in text
    assert all(len(a.split(",")) <= 10 for a in re.findall(r"Relation \[(.*?)\]", text))


def test_lookup_join_spreads_unmatched_and_null_keys(spark):
    facts = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"),
                                      F.col("id").alias("v")).repartition(6)
    dim = spark.createDataFrame([(1, "a"), (4, "b")], "k long, name string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.lookup_join(facts, dim, "k", share=0.05)
        assert got.count() == 30000
        assert {(r.k, r.name) for r in got.filter("name is not null").collect()} == {(1, "a"), (4, "b")}
        most = max(r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect())
        assert most < 12000             # 10,000 rows have key 7, 10,000 have none; four partitions
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketches_add_up_and_find_every_frequent_key(spark):
    """Sketches of the days of a table, made while the days are written, against exact counts."""
    from driftwarden.operators import frequent
    rows = spark.range(60_000).select((F.col("id") % 3).alias("day"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
                                      .when(F.col("id") % 11 == 0, "warm").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.struct((F.col("id") % 5).alias("n")).alias("s"))
    parts = []
    for day in range(3):
        staged, sketched = frequent.stage_with_sketches(rows.filter(F.col("day") == day), "day", ["k", "s.n"])
        assert staged.count() == sketched.first()["rows"] == 20_000
        parts.append(sketched)
    whole = frequent.merged(parts[0].union(parts[1]).union(parts[2]))
    exact = {r.k for r in rows.filter("k is not null").groupBy("k").count().filter("count >= 60000 * 0.03").collect()}
    found = spark.range(1).select(F.sort_array(frequent.frequent(whole, "k", 0.03)).alias("a"), F.sort_array(frequent.frequent(whole, "s.n", 0.1)).alias("b"))
    assert found.first()["a"] == sorted(exact) == ["hot", "warm"] and found.first()["b"] == [0, 1, 2, 3, 4]
    dim = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, x int")
    got = joins.lookup_join(rows, dim, "k", sketched=whole, by=["s"])
    assert {(r.x, r["count"]) for r in got.groupBy("x").count().collect()} == {(1, 20_000), (2, 1), (None, 39_999)}


def test_ewma_rows_are_dealt_by_block(spark):
    """Blocks are few bytes for their rows: neither broadcast nor coalesced by size."""
    df = spark.createDataFrame([(u, t, float(u + t)) for u in range(20) for t in range(30)], "user_id int, hour_index int, x double")
    out = ewma.steps(df, "x", block=8, fan=2)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and out.count() == 600


def test_global_sample_ranks_whole_rows_once_their_digest_is_known(spark):
    rows = [(i % 90, i % 7, [float(i)] * 5) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, b int, wide array<double>")
    import hashlib
    order = sorted((hashlib.md5(f"3|{a}|{b}".encode()).hexdigest(), a, b) for a, b, _ in rows)
    for cap in (1, 25, 5000):
        out = ordering.capped_sample(df, ["a", "b"], [], cap, 3)
        assert sorted((r.a, r.b) for r in out.collect()) == sorted((a, b) for _, a, b in order[:cap])
    assert ordering.capped_sample(df.limit(0), ["a", "b"], [], 4, 3).count() == 0
    assert "Subquery" in ordering.capped_sample(df, ["a", "b"], [], 4, 3)._jdf.queryExecution().executedPlan().toString()
