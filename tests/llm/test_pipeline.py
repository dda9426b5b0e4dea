"""The pipeline's stages on a small table, each against what it should keep."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rnd.choices(words, k=60)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(5)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "s1", 1) for i in range(5, 10)]
    rows += [(300 + i, " ".join([*rnd.choices(words, k=20), *rnd.choices(["zagruk", "dremwit"], k=4)]), "en", "s2", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 0) for i in range(60)] + [(300 + i, 1) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows if r[0] < 300}
    exact = stage["exact_dedup"](spark, clean, str(tmp_path))
    assert exact.columns == docs.columns and {r.doc_id for r in exact.collect()} == {r[0] for r in rows if r[0] < 100 or 200 <= r[0] < 300}
    near = stage["ngram_jaccard_join"](spark, exact, str(tmp_path))
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == set(range(60))
    mixed = stage["mixing"](spark, near, str(tmp_path))
    assert mixed.columns == docs.columns and 20 <= mixed.count() <= 60
    packed = stage["packing"](spark, mixed, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole.collect() if r.start == 0) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed if r.start == 0)


def test_mixing_keeps_its_budget(spark, tmp_path):
    """One tiny source must not thin all others."""
    rnd = random.Random(10)
    rows = [(i, "word " * rnd.randint(10, 300), ("en", "de")[i % 5 == 0], f"s{i % 3}", 1) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (5000, "word " * 5, "en", "tiny", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, str(tmp_path)).collect()
    assert len({r.doc_id for r in kept}) == len(kept)
    assert 0.77 < sum(len(r.text) for r in kept) / sum(len(r[1]) for r in rows) < 0.83
    assert 5000 in {r.doc_id for r in kept}


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and an empty table go through every stage."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some words here", "en", None, 3), (4, "x " * 5000, "de", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1), (None, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        left = table
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, str(tmp_path))
            assert name == "packing" or left.columns == docs.columns
        assert left.count() <= 20
