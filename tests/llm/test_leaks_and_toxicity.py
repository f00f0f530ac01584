"""Benchmark decontamination against a plain edit table; toxicity on held-out rows and small cases."""

import random
import zlib

from driftwarden.llm import decontaminate as dc
from driftwarden.llm import toxicity as tox


def closest(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def fixture():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(7, 30)))) for i in range(6)]
    items += [(6, None), (7, "short"), (None, "a text without an id but long enough"), (8, items[0][1])]
    docs = []
    for i in range(40):
        text = " ".join(word() for _ in range(rnd.randint(0, 40)))
        if rnd.random() < .6:
            leak = list(rnd.choice(items[:6])[1])
            for _ in range(rnd.choice([0, 1, 3, 8, 30])):
                leak[rnd.randrange(len(leak))] = rnd.choice("xyz")
            text += ", " + "".join(leak).upper() + "! " + text
        docs.append((i, text))
    return docs + [(100, None), (101, ""), (None, items[1][1]), (3, items[2][1])], items


def test_leaks_against_edit_table(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.distance) for r in dc.find_leaks(d, b).collect())
    want = []
    for doc, text in docs:
        for item, body in items:
            plain = dc.normalised(body)
            if item is not None and body and len(plain) >= dc.EXACT_CHARS:
                distance = closest(plain, dc.normalised(text))
                if distance <= int(dc.RATE * len(plain)):
                    want.append((str(doc), item, distance))
    assert got == sorted(want) and want
    hit = {x[0] for x in want}
    kept = dc.without_leaks(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(i) for i, t in docs if str(i) not in hit or (i == 3 and t == docs[3][1] and not any(
            closest(dc.normalised(x), dc.normalised(t)) <= int(dc.RATE * len(dc.normalised(x))) for _, x in items[:6])))


def test_leaks_in_blocks_and_empty(spark, monkeypatch):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, dc.find_leaks(d, b).collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 200)
    assert sorted(map(str, dc.find_leaks(d, b).collect())) == whole
    assert dc.find_leaks(d, b.limit(0)).collect() == [] == dc.find_leaks(d.limit(0), b).collect()


def test_toxic_rows_of_the_held_out_part(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = tox.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    seen = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    found = [p for t, p in seen if t]
    wrong = [p for t, p in seen if not t]
    assert sum(found) / len(found) > 0.8 and sum(wrong) / len(wrong) < 0.01


def test_folding_and_exceptions():
    entries = (("idiot ", 3.0), ("lose", 2.0))
    for text in ("You IDIOT!", "you id1ot", "уоu іdіоt", "ｉｄｉｏｔ", "such an idi\u200bot"):
        assert tox.features(text, entries, ())[2] == 3.0, text
    assert tox.features("idiotic enclose", entries, ())[2] == 0.0
    assert tox.features("a sore loser", entries, ("sore loser",))[0] == 0.0
    assert tox.features("a loser", entries, ("sore loser",))[2] == 2.0
    assert tox.features(None, entries, ()) == tox.features("", entries, ()) == [0.0, 0.0, 0.0]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, "x " * 5000, 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in tox.score_documents(docs, none).collect()] == [(0.0, 0)] * 3
    assert tox.without_toxic(docs, none).count() == 3


def test_short_items_and_every_place(spark):
    """Items under 24 characters exactly and as whole words; all places of an item; two items at one place; a long text."""
    long_item = "the quick brown fox jumps over the lazy dog at noon"
    items = [(1, "Capital of Peru"), (2, long_item), (3, long_item.upper() + "!"), (4, "a b"), (5, "peru is a state")]
    docs = [(1, "What is the capital  of Peru? The CAPITAL-OF-PERU"), (2, "capital of peruvians, xcapital of peru"),
            (3, f"{long_item} {long_item.replace('lazy', 'lazi')}, {'x ' * 40_000} {long_item}"), (4, "a b"), (5, "capital of peru is a state")]
    got = dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    rows = sorted((r.doc_id, r.item_id, r.distance, r.start, r.stop) for r in got)
    assert [r[:2] for r in rows if r[0] != 3] == [(1, 1), (1, 1), (5, 1), (5, 5)]
    for doc, item, distance, start, stop in rows:
        plain, wanted = dc.normalised(dict(docs)[doc]), dc.normalised(dict(items)[item])
        assert closest(wanted, plain[start:stop]) == distance == (0 if item not in (2, 3) else distance)
    assert [r[1:3] for r in rows if r[0] == 3] == [(2, 0), (2, 0), (2, 1), (3, 0), (3, 0), (3, 1)]
    kept = dc.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4]
