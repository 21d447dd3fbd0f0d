"""The pipeline's stages, each on its own input."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path):
    passage = " ".join(f"secret{k}" for k in range(14))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clean = [" ".join(f"{w}{k}{'ing' if k % 2 else 'er'}" for w in ("un", "the", "of") for k in range(20)) + f" number{n} word{n} end{n}\nlast line {n} goes here" for n in range(6)]
    rows = [(n, t + " " + " ".join(f"own{n}x{k}" for k in range(60)), "en", "s", 1) for n, t in enumerate(clean)]
    rows += [(10, rows[0][1] + " tail", "en", "s", 1), (11, "before " + passage + " after", "en", "s", 1), (12, None, None, None, None), (13, "123", None, None, None), (None, "no id here", "en", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    return f"file://{tmp_path}", docs


def test_each_stage_drops_what_it_should(spark, tmp_path):
    sf_dir, docs = folder(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.collect()}
    everything = ids(docs)
    assert ids(stages["language_id"](spark, docs, sf_dir)) == everything - {12, 13}
    assert ids(stages["line_dedup"](spark, docs, sf_dir)) == everything
    assert ids(stages["minhash_near_dedup"](spark, docs, sf_dir)) == everything - {10}
    assert ids(stages["decontamination"](spark, docs, sf_dir)) == everything - {11}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert stages["best_fit_packing"](spark, docs.limit(0), sf_dir).count() == 0


def test_run_chains_the_stages(spark, tmp_path):
    sf_dir, _ = folder(spark, tmp_path)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 4, 5, None} and all(r.length <= 4096 for r in rows)
