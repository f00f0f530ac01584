"""Source mix, URL rules, licence scan, transcripts and top-k against brute force on small tables."""

import math
import random
import re

import numpy as np

from driftwarden.llm import chat, licences, mixing, topk, url_rules


def sources():
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "é", None]), "w " * int(rnd.paretovariate(.9) * 5 % 400)) for i in range(600)]
    return rows + [(7000, "c", "x y z"), (None, "a", "p q"), (None, None, None), (7001, "d", ""), (7001, "d", None),
                   *[(8000, "b", "one two three")] * 7]


def test_mix(spark):
    rows = sources()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, size string").repartition(6)
    got = mixing.mix_sizes(df).collect()
    assert len(got) == len(rows)
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted([s for s in size if s is not None], key=lambda s: s.encode()) + [None]
    weight, cap = {s: i % 3 + 1.0 for i, s in enumerate(names)}, {s: 3 * size[s] for s in names}
    full, level = set(), 0.0
    while True:
        level = (sum(size.values()) - sum(cap[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if level * weight[s] > cap[s]}
        if more == full:
            break
        full = more
    for s in names:
        own = [r for r in got if r.source == s]
        target = min(level * weight[s], cap[s])
        assert all(math.isclose(r.target, target, rel_tol=1e-9) and r.source_size == size[s] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(3, 0.02 * size[s])
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in got)
    assert sorted(map(str, mixing.mix_sizes(df.repartition(2)).collect())) == sorted(map(str, got))
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "copies"]
    assert sum(r.copies * len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)


def test_mix_is_fair(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * (1 + i % 9)) for i in range(400)], "doc_id long, source string, text string")
    share = [r.copies for r in mixing.mix_sizes(df, weights=(1.0, 3.0)).collect() if r.source == "a"]
    assert 0.35 < sum(share) / len(share) < 0.65
    assert mixing.mix_sizes(df.limit(0)).collect() == []


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.Net/x?y", "https://example.net/en/x", "https://x.example.net/en",
            "https://www.example.net/en/#t", "https://notexample.net/en/", "ftp://example.com/de/a/b?c", "http://org/fr/", "http://borg/fr/",
            "http://a.org.example.com/de/", "x://a..net/", "http://é.net/", "mailto:a@b://net/q", "http://net\n/x", "http://.net/"]
    rnd = random.Random(1)
    urls += ["http://" + ".".join(rnd.choice(["a", "net", "org", "example", "com", "x-y"]) for _ in range(rnd.randint(1, 4)))
             + rnd.choice(["", "/", "/en/", "/de/x", "/fr/y?z"]) for _ in range(300)]
    rules = list(url_rules.RULES) + [("allow", "a.net", "/"), ("block", "x-y.a.net", "/de/"), ("allow", "x.y", "/"), ("block", "net", "/en/"),
                                     ("allow", None, "/")]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[5], "h")], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_rules.judge(df.repartition(3), spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), u
    assert url_rules.judge(df.limit(0), url_rules.given_rules(spark)).collect() == []


def test_licences(spark):
    rnd = random.Random(2)
    voc = "cc by general public license all rights reserved the é gnu K x2".split()
    texts = [None, "", "CC-BY", "cc by cc by", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
             "cc by" * 3, "K cc by", "general public licenseé", "x " * 30000 + "ALL RIGHTS RESERVED"]
    texts += [rnd.choice([" ", "-", "_", "\n"]).join(rnd.choice(voc) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "cc by", 1)], "doc_id long, text string, row int")
    got = {r.doc_id: r for r in licences.scan(df.repartition(3)).collect()}
    for i, t in enumerate(texts):
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(j, b.label) for b in licences.BASE for j in range(len(words)) if words[j:j + len(b.words)] == b.words]
        want = (len(words), len(at), min([j for j, _ in at], default=None), max([j for j, _ in at], default=None),
                ",".join(sorted({x for _, x in at})))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[4].labels == "apache" and got[5].labels == "mit" and got[None].n_base == 1
    assert licences.scan(df.limit(0)).collect() == []


def test_licence_key_phrases(spark):
    grant = "permission is hereby granted free of charge to any person acquiring a copy"
    texts = [grant, grant + " " + "x " * 50 + "obtaining", "licensed under the MIT license", "released in binary forms", "of obtaining released"]
    texts += ["mit license", "license hereby granted free permission charge person copy mit"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert [got[i].labels for i in range(6)] == ["mit", "mit", "mit", "", "", "mit"]
    assert got[0].score == got[1].score and 0 < got[2].score < licences.SHARE
    common = (licences.Template("odd", "to be or not", "to be or", named=True),)
    assert [r.labels for r in licences.scan(df.limit(1).selectExpr("1L doc_id", "'to be or maybe' text"), common).collect()] == ["odd"]


def test_transcripts(spark, monkeypatch):
    rnd = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rnd.randint(1, 9)):
            role = chat.ROLES[1 + t % 2] if t or c % 4 else "system"
            mark = {"user": "Human: ", "assistant": "### Assistant: ", "system": "<|im_start|>system|> "}[role] if rnd.random() < .6 else ""
            rows.append((c, t, role if rnd.random() < .9 else None, mark + "w " * rnd.randint(1, 20 if role == "user" else 200)))
    rows += [(None, 0, "user", None), (None, None, "odd", ""), (5, 0, rows[5][2], rows[5][3]), (5, 0, rows[5][2], rows[5][3])]
    rows += [(999, t, None, "Human: x" if t % 2 == 0 else "AI: y") for t in range(300)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, seq int").repartition(4)
    results = []
    for block in (512, 7):
        monkeypatch.setattr(chat, "BLOCK", block)
        chained = chat.with_previous(chat.chained(df))
        model = chat.learn(chained)
        got = chat.recover_roles(chained, model).join(chained, "seq").orderBy("seq").collect()
        assert len(got) == len(rows)
        pdf = [r for r in got]
        seen = {k: np.array([r.seen[k] for r in pdf]) for k in chat.FEATURES}
        first = np.array([r["first"] for r in pdf])
        mats = chat.line_matrices(first, seen, model)
        assert [r.state for r in pdf] == chat.decode(mats, 0, None).tolist()
        results.append([(r.conv_id, r.turn, r.state) for r in pdf])
    assert results[0] == results[1]
    out = chat.parse_transcripts(df).collect()
    assert len(out) == len(rows)
    right = [r.parsed_role == ("user" if r.turn % 2 == 0 else "assistant") for r in out if r.conv_id == 999]
    assert sum(right) / len(right) > 0.95
    assert all(r.rendered.startswith(f"<|{r.parsed_role}|>\n") and "Human:" not in r.rendered for r in out)
    assert chat.parse_transcripts(df.limit(0)).collect() == []
    lines = chat.split_transcripts(spark.createDataFrame([(1, "User: a\n\nBot: b"), (2, None)], "conv_id long, text string")).collect()
    assert [(r.conv_id, r.turn, r.text) for r in lines] == [(1, 0, "User: a"), (1, 2, "Bot: b")]


def test_lines_become_turns(spark, monkeypatch):
    raw = [(1, "User: hi\nBot: one\ntwo\n\nthree\nHuman: and?\nAI: yes\nUser: is a word"), (2, "\n".join(["User: q"] + ["Bot: x"] + ["y"] * 40))]
    want = [(1, "user", "hi"), (1, "assistant", "one\ntwo\n\nthree"), (1, "user", "and?"), (1, "assistant", "yes"), (1, "user", "is a word"),
            (2, "user", "q"), (2, "assistant", "\n".join(["x"] + ["y"] * 40))]
    want = sorted((c, r, f"<|{r}|>\n{t}\n<|end|>") for c, r, t in want)
    seen = lambda df: sorted((r.conv_id, r.parsed_role, r.rendered) for r in df.collect())
    whole = spark.createDataFrame([(c, 0, None, t) for c, t in raw], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert seen(chat.parse_transcripts(whole, across=True)) == want
    taught = spark.createDataFrame([(c, t, chat.ROLES[1 + t % 2], ["User: a", "Bot: b\nc\nd\ne"][t % 2]) for c in range(30) for t in range(4)], whole.schema)
    model = chat.learn(chat.with_previous(chat.chained(taught)))
    lines = chat.split_transcripts(spark.createDataFrame([raw[1]], "conv_id long, text string"))
    assert seen(chat.parse_transcripts(lines, model, raw=True)) == [x for x in want if x[0] == 2]
    assert len(chat.parse_transcripts(lines, model).collect()) == 42


def test_top_k(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([0.0, 0.5, 1.0, -.3]) for _ in range(3)]) for i in range(300)]
    rows += [(1000, None), (1050, [1.0, None, 2.0]), (None, [1., 1., 1.]), (1100, [float("nan"), 1., 1.]), (1150, [float("inf"), 1., 1.])]
    rows += [(2000 + i, [1.0, 1.0, 1.0]) for i in range(200)]
    vec = {i: [math.floor(256 * x) for x in v] for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in vec:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(vec[q], v)), c) for c, v in vec.items() if c != q)[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "ROWS", 16)
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    assert sorted(map(tuple, topk.search_embeddings(df, 50, 5).collect())) == sorted(want)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert len(topk.search_embeddings(few, 50, 5).collect()) == 2
    assert topk.search_embeddings(few.limit(0), 50, 5).collect() == []
