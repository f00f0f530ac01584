"""Suffix-array and FM-index deduplication against a brute-force window index."""

import hashlib
import random

import pytest

from driftwarden.llm import fm_index, repeats, suffix_array


def fixture():
    rnd = random.Random(5)
    voc = [f"w{i}" for i in range(300)] + ["é", "ñandú"]
    passages = [[rnd.choice(voc) for _ in range(rnd.choice([49, 50, 51, 60, 120, 300]))] for _ in range(10)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += [rnd.choice(voc) for _ in range(rnd.randint(0, 40))]
            if rnd.random() < .6:
                p = rnd.choice(passages)
                words += p[rnd.randint(0, len(p) // 3):] if rnd.random() < .5 else p
        if rnd.random() < .1:
            words = words[:30] * 6
        rows.append((i * 3 % 1001, rnd.choice([" ", "\n", " \t"]).join(words)))
    rows += [(rows[7][0] + 5000, rows[7][1]), (2, None), (4, ""), (None, rows[7][1]), (rows[7][0], rows[7][1]),
             (rows[9][0], rows[8][1]), (-5, " ".join(passages[5])), (9000, " ".join(passages[4] * 30))]
    return rows + [(7000 + i, " ".join(passages[3][:60] + [f"x{i}"])) for i in range(90)]


def removed(rows):
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        if doc is not None:
            for i in range(len(words) - 49):
                key = tuple(words[i:i + 50])
                first[key] = min(first.get(key, 1 << 60), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        if doc is not None:
            for i in range(len(words) - 49):
                if first[tuple(words[i:i + 50])] < doc:
                    gone[i:i + 50] = [True] * 50
        out.append((doc, words, gone))
    return out


def expected(rows):
    return sorted((str(d), len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest())
                  for d, w, g in removed(rows))


@pytest.mark.parametrize("per_salt", [4096, 40])
@pytest.mark.parametrize("dedup", [suffix_array.dedup_suffixes, fm_index.dedup_substrings])
def test_against_brute_force(spark, monkeypatch, dedup, per_salt):
    monkeypatch.setattr(repeats, "PER_SALT", per_salt)
    rows = fixture()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(5)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in dedup(df).collect())
    assert got == expected(rows)


def test_texts_are_cut(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, spans int").repartition(3)
    got = {r.spans: (r.doc_id, r.text) for r in suffix_array.cut_repeats(df).collect()}
    for i, ((doc, text), (_, words, gone)) in enumerate(zip(rows, removed(rows))):
        kept = [w for w, g in zip(words, gone) if not g]
        if words and not kept:
            assert i not in got
        elif any(gone):
            assert got[i][1].encode().split() == kept
        else:
            assert got[i] == (doc, text)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.dedup_suffixes(df).collect() == [] == fm_index.dedup_substrings(df).collect()
    assert suffix_array.cut_repeats(df).collect() == []


def test_fm_index_counts():
    import numpy as np
    rnd = np.random.default_rng(2)
    text = np.append(rnd.integers(1, 6, 400), 0)
    index = fm_index.FMIndex(text, np.arange(len(text)))
    for size in (1, 2, 5):
        for at in range(0, 300, 37):
            low, high = np.array([0]), np.array([len(text)])
            pattern = text[at:at + size]
            for c in pattern[::-1]:
                low, high = index.extend(np.array([c]), low, high)
            places = [i for i in range(len(text) - size + 1) if (text[i:i + size] == pattern).all()]
            assert high[0] - low[0] == len(places) and index.least_owner(low, high)[0] == places[0]


def test_words_whose_short_hashes_collide(spark):
    """`k108223` and `k152967` agree in the low 32 bits of their hashes."""
    before, after = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(5)]
    rows = [(1, " ".join([*before, "k108223", *after])), (2, " ".join([*before, "k152967", *after]))]
    for dedup in (suffix_array.dedup_suffixes, fm_index.dedup_substrings):
        got = {r.doc_id: r.n_removed for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: 0, 2: 60}


def test_long_patterns_around_breaks():
    """Copies with changed words, at every distance, against windows looked up one by one."""
    import numpy as np
    rnd = random.Random(3)
    for trial in range(30):
        base = [rnd.randrange(40) for _ in range(300)]
        segs = []
        for doc in rnd.sample(range(100), rnd.choice([2, 5, 9])):
            words = base[rnd.randrange(60):rnd.randrange(150, 300)]
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                words[rnd.randrange(len(words))] = rnd.choice([rnd.randrange(40), 1000 + doc])
            segs += [(doc, words)] * rnd.choice([1, 1, 2])
        flat = np.concatenate([np.array(w, np.int64) for _, w in segs])
        offset = np.cumsum([0, *(len(w) for _, w in segs)])
        n = len(segs)
        seg = repeats.Segments(np.zeros(n, np.int64), np.array([d for d, _ in segs]), flat.view(np.uint64), flat, offset,
                               np.zeros(n, np.int64), np.diff(offset) - 49)
        first = {}
        for doc, w in segs:
            for i in range(len(w) - 49):
                first[tuple(w[i:i + 50])] = min(first.get(tuple(w[i:i + 50]), 1000), doc)
        for (doc, w), least in zip(segs, fm_index.least_by_search(seg)):
            assert [x < doc for x in least.tolist()] == [first[tuple(w[i:i + 50])] < doc for i in range(len(w) - 49)]
