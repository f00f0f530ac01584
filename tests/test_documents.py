import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from driftwarden import fixed_values as fv
from driftwarden.functions import similarity as sim, text as tx
from driftwarden.operators import matching, pii


def brute_overlaps(spans):
    kept = []
    for s in sorted(spans, key=lambda x: (-x[3], x[1])):
        if not any(s[1] < k[2] and k[1] < s[2] for k in kept):
            kept.append(s)
    return set(kept)


def test_overlap_suppression_equals_greedy(spark):
    rng = random.Random(3)
    docs = {}
    for d in range(12):
        spans = set()
        while len(spans) < 40:
            start = rng.randrange(0, 150)
            spans.add((f"R{len(spans)}", start, start + rng.randrange(1, 15), rng.randrange(100) / 100 + len(spans) / 1e6))
        docs[d] = spans
    df = spark.createDataFrame([(d, *s, "v") for d, ss in docs.items() for s in ss],
                               "doc_id int, recogniser string, start int, end int, score double, value string")
    got = {}
    for r in pii.suppress_overlaps(df.repartition(3)).collect():
        got.setdefault(r.doc_id, set()).add((r.recogniser, r.start, r.end, r.score))
    assert got == {d: brute_overlaps(s) for d, s in docs.items()}


TEXT = """EMPLOYEE RECORD
Name: Sara Malik
CNIC: 35202-1234567-1
Date of Birth: 1990-04-17
Email: sara.malik@example.com
Phone: (021) 555-0134
Address: 12 Canal Road, Lahore
Card No: 4111 1111 1111 1111
Temp Password: Xk9wPq27Lm
bad card 4111 1111 1111 1112 and é at the end"""


def test_rules_find_every_entity(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "nothing here"), (3, None)], "doc_id int, text string")
    hits = pii.recognise(df)
    assert hits.join(df, "doc_id").filter("substring(text, start + 1, end - start) <> value").count() == 0
    found = {(r.type, r.value) for r in pii.entities(pii.suppress_overlaps(hits)).collect()}
    assert found == {("PERSON", "Sara Malik"), ("NID", "35202-1234567-1"), ("DOB", "1990-04-17"), ("EMAIL", "sara.malik@example.com"),
                     ("PHONE", "(021) 555-0134"), ("ADDRESS", "12 Canal Road, Lahore"), ("CREDIT_CARD", "4111 1111 1111 1111"),
                     ("PASSWORD", "Xk9wPq27Lm")}
    rows = {r.doc_id: r for r in pii.scan_documents(df).collect()}
    assert (rows[1].high_entities, rows[1].medium_entities, rows[1].low_entities) == (3, 3, 2)
    assert rows[1].sensitivity_score == 47 and rows[1].action_taken == "ALERT" and rows[2].action_taken == "PERMIT"


def test_context_raises_score(spark):
    df = spark.createDataFrame([(1, "Temp Password: Xk9wPq27Lm"), (2, "code Xk9wPq27Lm")], "doc_id int, text string")
    s = {r.doc_id: r.score for r in pii.recognise(df).collect()}
    assert s[1] == pytest.approx(0.85) and s[2] == 0.5


def test_routes(spark):
    rows = [("text_extractable", None), ("scanned", 0.85), ("scanned", 0.8499), ("handwritten", None)]
    df = spark.createDataFrame(rows, "c string, p double")
    assert [r[0] for r in df.select(pii.route(F.col("p"), F.col("c"), 0.85)).collect()] == [fv.BRANCH1, fv.BRANCH2, fv.BRANCH3, fv.BRANCH3]
    kinds = [("DOCX", None), ("richtext", 0.1), ("png", None), ("png", 0.9), ("png", 0.2), (None, 0.2)]
    df = spark.createDataFrame(kinds, "k string, p double")
    assert [r[0] for r in df.select(pii.serving_branch(F.col("k"), F.col("p"))).collect()] == [
        fv.BRANCH1, fv.BRANCH1, fv.SERVING_BRANCH2, fv.SERVING_BRANCH2, fv.SERVING_BRANCH3, fv.SERVING_BRANCH3]


def test_ocr_rollup_weights_by_characters(spark):
    df = spark.createDataFrame([(1, 2, "bb", 0.5), (1, 1, "aaaa", 1.0), (2, 1, "", 0.3)], "doc_id int, box_no int, text string, confidence double")
    got = {r.doc_id: r for r in pii.ocr_rollup(df).collect()}
    assert got[1].transcript == "aaaa\nbb" and got[1].confidence == pytest.approx(5 / 6) and got[2].confidence == 0.0


def plain_fold(v):
    v = unicodedata.normalize("NFKD", v)
    v = "".join(c for c in v if not unicodedata.combining(c)).lower()
    return "".join(c for c in v if c.isascii() and (c.isalnum() or c == "@"))


def brute_match(gold, pred, threshold, exact):
    free, tp = list(range(len(gold))), 0
    for kind, value in pred:
        best, score = None, 0.0
        for i in free:
            if gold[i][0] != kind:
                continue
            a, b = plain_fold(gold[i][1]), plain_fold(value)
            s = 1.0 if a == b else 0.0 if exact or not a or not b else SequenceMatcher(None, a, b).ratio()
            if s >= threshold and s > score:
                best, score = i, s
        if best is not None:
            free.remove(best)
            tp += 1
    return tp, len(pred) - tp, len(free)


def random_docs(seed, n=40):
    rng = random.Random(seed)
    words = ["sara malik", "Sara Malik", "sara malick", "sára-malik", "omar", "omer", "4111 1111", "4111-1111", "41111112", "", " - "]
    pick = lambda: [(rng.choice(["PERSON", "NID"]), rng.choice(words)) for _ in range(rng.randrange(0, 7))]
    return [(i, pick(), pick()) for i in range(n)]


def test_matching_equals_brute_force(spark):
    docs = random_docs(7)
    schema = f"doc_id int, gold {matching.ENTITY_LIST}, pred {matching.ENTITY_LIST}"
    df = spark.createDataFrame(docs, schema)
    totals = {r.doc_id: (r.tp, r.fp, r.fn) for r in matching.match_fuzzy(df).groupBy("doc_id").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()}
    gold, pred = (df.select("doc_id", F.inline(c)) for c in ("gold", "pred"))
    exact = {r.doc_id: (r.tp, r.fp, r.fn) for r in matching.match_exact(gold, pred).groupBy("doc_id").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()}
    for i, g, p in docs:
        assert totals.get(i, (0, 0, 0)) == brute_match(g, p, fv.FUZZY_THRESHOLD, False)
        assert exact.get(i, (0, 0, 0)) == brute_match(g, p, fv.FUZZY_THRESHOLD, True)
        assert exact.get(i, (0, 0, 0))[0] <= totals.get(i, (0, 0, 0))[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("AB"), st.text("abc", max_size=6)), max_size=8),
       st.lists(st.tuples(st.sampled_from("AB"), st.text("abc", max_size=6)), max_size=8))
def test_greedy_pairs_equal_brute_force(gold, pred):
    assert len(matching.greedy_pairs(gold, pred, 0.85)) == brute_match(gold, pred, 0.85, False)[0]


def test_similarity_udf_and_bound(spark):
    pairs = [("Sara Malik", "sara.malik"), ("Sara Malik", "Sara Malick"), ("", "x"), ("abc", "xyz")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.s for r in df.select(sim.similarity("a", "b").alias("s")).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(SequenceMatcher(None, "saramalik", "saramalick").ratio()) and got[2] == got[3] == 0.0
    assert all(sim.length_bound(tx.fold(a), tx.fold(b)) >= g for (a, b), g in zip(pairs, got))


def test_tau_sweep_equals_reassembly(spark):
    rng = random.Random(1)
    docs, counts = [], []
    for i in range(60):
        cat = rng.choice(fv.CATEGORIES)
        conf = None if cat == "text_extractable" else rng.randrange(40, 101) / 100
        docs.append((i, cat, conf))
        for b in (fv.BRANCH1, fv.BRANCH2, fv.BRANCH3):
            counts.append((i, b, "NID", rng.randrange(4), rng.randrange(4), rng.randrange(4)))
    d = spark.createDataFrame(docs, "doc_id int, category string, confidence double")
    c = spark.createDataFrame(counts, "doc_id int, branch string, type string, tp bigint, fp bigint, fn bigint")
    sweep = {r.step: r for r in matching.tau_sweep(d, c).collect()}
    assert len(sweep) == 51
    for step in (50, 73, 85, 100):
        m = matching.micro(matching.assemble(d, c, step / 100)).first()
        assert (sweep[step].tp, sweep[step].fp, sweep[step].fn) == (m.tp, m.fp, m.fn)


def test_silent_predictors_miss_all_gold(spark):
    gold = spark.createDataFrame([("d", "EMAIL", "a@b.c"), ("d", "NID", "1")], "doc_id string, type string, value string")
    pred = spark.createDataFrame([("d", "EMAIL", "a@b.c", "x")], "doc_id string, type string, value string, branch string")
    for rows, hits in ((pred, 1), (pred.limit(0), 0)):
        out = {(r.branch, r.type): (r.tp, r.fp, r.fn) for r in matching.match_exact(
            gold, rows, ["doc_id"], ["branch"], ["x", "y"]).collect()}
        assert out[("y", "EMAIL")] == out[("y", "NID")] == (0, 0, 1)
        assert out[("x", "EMAIL")] == (hits, 0, 1 - hits)


def test_international_phones_and_shorter_cards(spark):
    text = ("Name: Ada Byron\nAddress: 1 Long Road\nCNIC 12345-1234567-1, born 1990-01-02, mail a.b@c.org\n"
            "phone +92 312 3456789 card 3782 822463 10005 temp password aB3dE6gH9")
    df = spark.createDataFrame([(1, text), (2, "call +923123456789, card 4222222222222"), (3, "no 378282246310006")], "doc_id bigint, text string")
    found = {}
    for r in pii.recognise(df).collect():
        found.setdefault(r.doc_id, {}).setdefault(r.recogniser, set()).add(r.value)
    assert set(found[1]) >= {r.recogniser for r in tx.RULES}
    assert found[1]["PHONE_NUMBER"] == {"+92 312 3456789"} and found[1]["CREDIT_CARD"] == {"3782 822463 10005"}
    assert found[2]["PHONE_NUMBER"] == {"+923123456789"} and found[2]["CREDIT_CARD"] == {"4222222222222"}
    assert "CREDIT_CARD" not in found.get(3, {})
