"""Registered queries of the corpus operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwarden.llm import (chat, decontaminate, fm_index, licences, merkle, mixing, near_duplicates, prefix_trie, simhash,
                             suffix_array, topk, toxicity, url_rules)

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_source_mix")
def source_mix(spark, sf_dir):
    return mixing.mix_sizes(table(spark, sf_dir, "documents"), weights=(1.0, 2.0, 3.0)).drop("copies")


@query("op2_url_rules", """
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
                 FROM pages),
    parts AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1) AS raw,
                     regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
    urls AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
    rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                            ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    judged AS (SELECT u.*, (SELECT max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': verdict}) FROM rules
                            WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best FROM urls u)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged""")
def url_verdicts(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.given_rules(spark))


@query("op3_toxicity")
def toxicity_scores(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_minhash_near_dedup")
def minhash_near_dedup(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), n=5, similarity=0.85).drop("body")


@query("op5_suffix_array_dedup")
def suffix_array_dedup(spark, sf_dir):
    return suffix_array.dedup_suffixes(table(spark, sf_dir, "documents")).drop("fp")


@query("op6_substring_dedup")
def substring_dedup(spark, sf_dir):
    return fm_index.dedup_substrings(table(spark, sf_dir, "documents")).drop("fp", "spans")


@query("op7_license_scan")
def license_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op8_chat_format")
def chat_format(spark, sf_dir):
    return chat.parse_transcripts(table(spark, sf_dir, "conversations"), across=True)


@query("op9_decontamination")
def decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
               FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                      CAST(list_inner_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) AS score
               FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""")
def top_k_search(spark, sf_dir):
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op11_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


CRC = """list_reduce(list_concat([4294967295], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
            lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [1, 2, 3, 4, 5, 6, 7, 8]),
                                          lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""


def crc_sql(value: str) -> str:
    """SQL for the unsigned CRC-32 of a number's decimal digits."""
    return f"xor({CRC.format(value)}, 4294967295)"


@query("op12_merkle_manifest", f"""
    WITH RECURSIVE coded AS (
        SELECT doc_id, source,
               coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
               text, CASE WHEN {crc_sql('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
    leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                      sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed FROM coded),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos FROM leaves),
    lower_nodes AS (SELECT source, 0 AS lvl, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM placed
        UNION ALL
        SELECT source, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3
        FROM lower_nodes WHERE n > 1 GROUP BY source, lvl, pos // 3),
    subroots AS (SELECT source, digest AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
                 FROM lower_nodes WHERE n = 1),
    upper_nodes AS (SELECT 0 AS lvl, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
        UNION ALL
        SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3
        FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 3),
    steps AS (SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                     coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
              FROM lower_nodes a JOIN lower_nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
              WHERE a.n > 1 GROUP BY ALL),
    upper_steps AS (SELECT a.lvl, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                           coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
                    FROM upper_nodes a JOIN upper_nodes b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
    walk AS (SELECT doc_id, leaf, changed, source, pos, 0 AS lvl, false AS up, changed AS node, '' AS proof FROM placed
        UNION ALL
        SELECT w.doc_id, w.leaf, w.changed, w.source,
               CASE WHEN s.lvl IS NOT NULL THEN w.pos // 3 WHEN NOT w.up THEN r.pos ELSE w.pos // 3 END,
               CASE WHEN s.lvl IS NULL AND NOT w.up THEN 0 ELSE w.lvl + 1 END,
               w.up OR s.lvl IS NULL,
               CASE WHEN s.lvl IS NOT NULL THEN sha256(s.before || w.node || s.after)
                    WHEN NOT w.up THEN w.node ELSE sha256(u.before || w.node || u.after) END,
               w.proof || CASE WHEN s.lvl IS NOT NULL THEN s.before || s.after WHEN NOT w.up THEN '' ELSE u.before || u.after END
        FROM walk w JOIN subroots r ON w.source IS NOT DISTINCT FROM r.source
        LEFT JOIN steps s ON NOT w.up AND w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.lvl AND w.pos = s.pos
        LEFT JOIN upper_steps u ON w.up AND w.lvl = u.lvl AND w.pos = u.pos
        WHERE NOT w.up OR u.lvl IS NOT NULL),
    done AS (SELECT * FROM walk WHERE up AND lvl = (SELECT max(lvl) FROM upper_nodes)),
    root AS (SELECT digest AS root FROM upper_nodes WHERE n = 1)
    SELECT d.doc_id, d.leaf, r.subroot, root.root, sha256(d.proof) AS proof_sha256, d.node AS folded_root, d.node = root.root AS verified
    FROM done d JOIN subroots r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN root""")
def merkle_manifest(spark, sf_dir):
    return merkle.verify(table(spark, sf_dir, "documents"))


@query("op13_conversation_prefix_trie", f"""
    WITH placed AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
            ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id, {crc_sql('conv_id')} % 4 AS h, conv_id - conv_id % 20 AS donor FROM (SELECT DISTINCT conv_id FROM placed)),
    turns AS (SELECT c.conv_id, 0 AS part, p.pos, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.donor AND p.pos < c.h
        UNION ALL SELECT c.conv_id, 1, p.pos, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos >= c.h),
    seqs AS (SELECT c.conv_id, list({{'role': t.role, 'text': t.text}} ORDER BY part, pos) FILTER (t.pos IS NOT NULL) AS seq
             FROM convs c LEFT JOIN turns t USING (conv_id) GROUP BY c.conv_id),
    prefixes AS (SELECT conv_id, d, coalesce(seq[1:d], []) AS prefix, d = coalesce(len(seq), 0) AS ends
                 FROM (SELECT *, unnest(range(coalesce(len(seq), 0) + 1)) AS d FROM seqs)),
    members AS (SELECT *, min(conv_id) OVER (PARTITION BY d, prefix) AS node FROM prefixes),
    nodes AS (SELECT node, d, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(prefix[d].text), '[^\\x20\\x09-\\x0D]+')) END AS words,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
              FROM members GROUP BY node, d),
    below AS (SELECT m.node AS top, m.d AS top_d, b.* FROM nodes b JOIN members m ON m.conv_id = b.node AND m.d <= b.d),
    kids AS (SELECT top AS node, top_d AS d, count(*) AS k FROM below WHERE d = top_d + 1 GROUP BY ALL),
    sums AS (SELECT top AS node, top_d AS d, CAST(sum((n - 1) * words) AS BIGINT) AS saved, count(*) FILTER (k IS NULL) AS leaves
             FROM below LEFT JOIN kids USING (node, d) GROUP BY ALL)
    SELECT n.node AS conv_id, n.d AS depth, up.node AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children, leaves AS n_leaves,
           saved AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums USING (node, d) LEFT JOIN kids k USING (node, d)
    LEFT JOIN members up ON up.conv_id = n.node AND up.d = n.d - 1""")
def conversation_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
