import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.functions import scores, text as tx, vectors
from driftwarden.operators import enforcement


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_worked_example_blocks(spark):
    s = scores.sensitivity(F.lit(5), F.lit(20), F.lit(15))
    a = scores.fuse(F.lit(0.62), F.lit(0.55), 0.25)
    r = one(spark, s.alias("s"), a.alias("a"), scores.serving_sbrs(s, a).alias("r"))
    assert r.s == 100 and r.a == pytest.approx(0.5675)
    assert r.r.sbrs_value == pytest.approx(2.4188, abs=1e-4) and r.r.enforcement_action == "BLOCK"


@pytest.mark.parametrize("value,action", [(1.84, "BLOCK"), (1.8399999, "ALERT"), (1.22, "ALERT"), (1.2199, "PERMIT"), (0.0, "PERMIT")])
def test_bands_are_inclusive_and_unrounded(spark, value, action):
    assert one(spark, scores.band_action(F.lit(value)).alias("x")).x == action


def test_serving_truncates_sensitivity_and_clamps(spark):
    r = one(spark, scores.serving_sbrs(F.lit(99.9), F.lit(1.7)).alias("r"), scores.sbrs(F.lit(99.9), F.lit(1.7)).alias("v")).r
    assert r.sensitivity_score == 99 and r.hybrid_anomaly_score == 1.0
    assert one(spark, scores.sbrs(F.lit(99.9), F.lit(1.7)).alias("v")).v == pytest.approx(99.9 * 3.5 / 100)


def test_wilson_matches_published_interval(spark):
    lo, hi = scores.wilson_bounds(F.lit(1), F.lit(51))
    r = one(spark, lo.alias("lo"), hi.alias("hi"), scores.wilson_bounds(F.lit(0), F.lit(0))[0].alias("none"))
    assert r.lo == pytest.approx(0.003469603253442241) and r.hi == pytest.approx(0.10304807675589372)
    assert math.isnan(r.none)


def test_geo_index_cases(spark):
    n = F.lit(None).cast("double")
    r = one(spark, scores.geo_index(F.lit(24.86), F.lit(67.01), F.lit(55.75), F.lit(37.62)).alias("far"),
            scores.geo_index(F.lit(1.0), F.lit(1.0), n, n).alias("one"), scores.geo_index(n, n, n, n).alias("none"))
    assert 0.8 < r.far < 0.9 and r.one == 0.0 and r.none == 0.5


def test_city_prefix_lookup(spark):
    r = one(spark, scores.city_coord(F.lit(" Sao Paulo , BR"), 0).alias("a"), scores.city_coord(F.lit("Atlantis"), 0).alias("b"),
            scores.city_coord(F.lit(None).cast("string"), 0).alias("c"))
    assert r.a == -23.55 and r.b is None and r.c is None


def test_file_class_and_activity_defaults(spark):
    r = one(spark, *[scores.file_class_of_sensitivity(F.lit(v).cast("double")).alias(f"f{i}") for i, v in enumerate((75, 50, 18, 0, None))],
            scores.activity_ratio(F.lit(500.0), F.lit(2.0)).alias("high"), scores.activity_ratio(F.lit(None), F.lit(2.0)).alias("none"),
            scores.scope_delta(F.lit(None).cast("string"), F.lit("HR")).alias("d0"), scores.scope_delta(F.lit("IT"), F.lit("HR")).alias("d1"))
    assert [r.f0, r.f1, r.f2, r.f3, r.f4] == [1.0, 2 / 3, 1 / 3, 0.0, 1 / 3]
    assert (r.high, r.none, r.d0, r.d1) == (10.0, 1.0, 0.0, 0.15)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1, 2, allow_nan=False), min_size=1, max_size=40))
def test_grid_rank_equals_brute_force(spark, values):
    values += [i / 100 for i in (2, 50, 98)] + [0.25, 12.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", scores.grid_rank("v", 100, 2, 98).alias("n"), scores.grid_rank("v", 4, 1, 48, True).alias("m")).collect()
    taus, ewma = [i / 100 for i in range(2, 99)], [i / 4 for i in range(1, 49)]
    for r in rows:
        assert r.n == sum(t <= r.v for t in taus) and r.m == sum(t < r.v for t in ewma)


def test_round_even_like_numpy(spark):
    xs = [0.5, 1.5, 2.5, 1.25195, 0.12345, 2.67895]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.y for r in df.select(scores.round_even("x", 4).alias("y")).collect()]
    assert got == list(np.round(xs, 4))


def test_lenient_parsing(spark):
    df = spark.createDataFrame([("N/A",), ("",), ("12",), (" 1.5 ",), ("abc",), (None,)], "t string")
    rows = df.select(tx.parse_number(F.col("t")).alias("d"), tx.parse_number(F.col("t"), "bigint").alias("i")).collect()
    assert [r.d for r in rows] == [None, None, 12.0, 1.5, None, None]
    assert [r.i for r in rows] == [None, None, 12, None, None, None]
    b = spark.createDataFrame([(" TRUE ",), ("false",), ("yes",), (None,)], "t string")
    assert [r[0] for r in b.select(tx.parse_bool(F.col("t"))).collect()] == [True, False, None, None]
    t = spark.createDataFrame([("2026-04-13 11:19:00",), ("soon",)], "t string").select(tx.parse_timestamp(F.col("t")).alias("t")).collect()
    assert t[0].t.minute == 19 and t[1].t is None


def test_reply_entities(spark):
    cases = {"": [], "  ": [], None: [], "```json\n[{\"type\":\"nid\",\"value\":\" 1 \"}]\n```": [("NID", "1")],
             "Sure: [{\"type\":\"EMAIL\",\"value\":\"a@b.c\"}] bye": [("EMAIL", "a@b.c")],
             "{\"entities\":[{\"type\":\"dob\",\"value\":\"x\"},{\"type\":\"CAT\",\"value\":\"y\"}]}": [("DOB", "x")],
             "[1, \"x\", {\"type\":\"PHONE\",\"value\":5}]": [("PHONE", "5")], "{\"a\":1}": None, "nothing": None, "[broken": None}
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    for row in df.withColumn("i", tx.reply_entities(F.col("r"))).withColumn("c", tx.clean_entities(F.col("i"))).collect():
        want = cases[row.r]
        assert (row.i is None) == (want is None), row
        assert [tuple(e) for e in row.c] == (want or [])


def test_normalise_and_slug(spark):
    values = ["Sara.Malik@X.com", "Ångström-Ø9", "ﬁle №5", "  ", "日本 12"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = tx.with_normalised(df, "v", "n").collect()
    assert [r.n for r in rows] == [tx.fold(v) for v in values]
    assert one(spark, tx.slug(F.lit("Vendor/Model-2.5:x")).alias("s")).s == "Vendor-Model-2-5-x"


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    r = one(spark, vectors.unit(a).alias("u"), vectors.top_k_mean(F.array(F.lit(1.0), F.lit(5.0), F.lit(3.0)), 2).alias("t"),
            vectors.top_k_mean(F.array(F.lit(1.0)), 10).alias("few"), vectors.left_pad_rows(F.array(a), 3, 2).alias("p"))
    assert r.u == [0.6, 0.8] and r.t == 4.0 and r.few == 1.0 and r.p == [[0.0, 0.0], [0.0, 0.0], [3.0, 4.0]]


def test_parameter_ranges():
    enforcement.check_parameters(0.0, 5.0, 1000)
    for bad in ({"alpha": 1.1}, {"beta": -0.1}, {"limit": 0}):
        with pytest.raises(ValueError):
            enforcement.check_parameters(**bad)


def test_fixed_tables_are_consistent():
    assert set(fv.ENTITY_TIER.values()) <= set(fv.ENTITY_WEIGHTS) and len(fv.PII_SCAN_COLUMNS) == 21
    assert len(fv.COMPARISON_COLUMNS) == 25 and len(fv.BASELINE_COLUMNS) == 11 and len(fv.BLOCKED_AUDIT_COLUMNS) == 12
