"""SimHash groups against all pairs of fingerprints that are counted bit by bit."""

import random

import pytest
import xxhash

from driftwarden.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    codes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(c >> bit & 1 for c in codes) > len(codes))


def brute(rows):
    codes, parent = [brute_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and (codes[a] ^ codes[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for a, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(a)] = min(least.get(root(a), 1 << 60), doc)
    return [(doc, f"{codes[a]:016x}", None if doc is None else least[root(a)]) for a, (doc, _) in enumerate(rows)]


def fixture():
    rnd, rows = random.Random(5), []
    voc = [f"w{i}" for i in range(300)]
    for size in (2, 3, 40, 400, 400, 60, 2500, 1):
        base = [rnd.choice(voc) for _ in range(size)]
        for _ in range(rnd.choice([1, 4, 40])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                words[rnd.randrange(len(words))] = rnd.choice(voc)
            text = rnd.choice([" ", "\t", "\n "]).join(words)
            rows.append((len(rows) * 7 % 2003 - 40, text if rnd.random() < .8 else text.upper()))
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "É é"), (9005, "É É"), (9006, "one"), (None, "one"), (None, None),
                   (9006, "one"), (9006, "two unlike words here"), (9007, "x\x1cy z\xa0z a\x85b c")]


def found(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component string").repartition(parts)
    got = simhash.near_duplicates(df).select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")
    return sorted(map(str, map(tuple, got.collect())))


@pytest.mark.parametrize("block, pairs", [(32_768, 4096), (5, 3)])
def test_against_all_pairs(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(simhash, "BLOCK", block)        # 5: many blocks, levels of ranges above them
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rows = fixture()
    assert found(spark, rows) == sorted(map(str, brute(rows)))


def test_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex("fp").alias("f"), "component_id")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


def test_long_texts_in_pieces(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["ab", "c", " ", "\n", "dé", "\t "]) for _ in range(4000)) + "x" * 500
    want = brute_fingerprint(text)
    for piece in (1 << 20, 700, 64, 1):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text) == want
        assert simhash.fingerprint("a b") == brute_fingerprint("a b") and simhash.fingerprint(" ") == 0


def test_chain_of_links(spark):
    """Groups reach over several links, whose ends differ in more bits, and over several blocks."""
    codes = [(1 << 3 * i) - 1 for i in range(20)] + [7 << 61 | (1 << 41) - 1]
    rows = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    from driftwarden.llm.components import components
    got = {r.node: r.component for r in components(simhash.links(rows, len(codes))).collect()}
    assert len(set(got.values())) == 1 and len(got) == 20


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
