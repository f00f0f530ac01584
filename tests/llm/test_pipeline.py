"""The pipeline's stages keep the documents' columns and do what their operators say, and it runs on an awkward table."""

import corpus_pipeline
from driftwarden.llm import decontaminate, fm_index, near_duplicates


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = stage(spark, docs, sf).cache()
        if name != "source_mix":
            assert seen[name].schema.names == start.schema.names
        docs = seen[name]
    dedup = seen["near_duplicates"]
    found = near_duplicates.near_duplicates(dedup).collect()
    assert all(r.kept for r in found) and dedup.count() < seen["toxicity"].count()
    assert fm_index.dedup_substrings(seen["repeated_passages"]).filter("n_removed > 0").count() == 0
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.find_leaks(seen["decontamination"], bench).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == seen["source_mix"].count() > 0


def test_awkward_table(spark, tmp_path):
    rows = [(1, None, None, None, 0, 1), (1, "", "en", "s", None, 2), (None, "a b", "en", "s", 3, 3), (2, "x " * 30000, None, "s", 1, 4),
            (2, "x " * 30000, None, "s", 1, 4), (3, "idiot " * 60, "en", None, 2, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int").limit(0).write.mode(
        "overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_stage_links_at_four_fifths(spark, sf):
    words = [f"w{i}" for i in range(304)]                       # 300 shingles; a word changed inside costs 5 of them
    near = [f"x{i}" if i in (50, 100, 150, 200, 250, 300) else w for i, w in enumerate(words)]       # 270 of 330: 0.818
    far = [f"y{i}" if i in (40, 80, 120, 160, 200, 240, 280) else w for i, w in enumerate(words)]    # 265 of 335: 0.791
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, sf).collect()) == [1, 3]
