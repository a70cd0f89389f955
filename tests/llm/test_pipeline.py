"""The pipeline's stages, each on its own input, and on hand-made rows."""

import corpus_pipeline
from tradebook.llm import decontamination, near_duplicates

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, gone_id string"
ROWS = [(None, None, None, None, None, None), (1, "", "", "", 0, "x"), (2, "a b c d e f", "en", "src0", 11, "x"), (2, "a b c d e f", "en", "src0", 11, "x"),
        (3, "A b c d e f", "en", "zzz", 11, "x"), (4, "word " * 30000, "en", "src1", 1, "x")]


def test_stages_take_any_rows(spark, sf_dir):
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, FIELDS)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "token_files":
                assert out.columns == docs.columns
            out.count()


def test_pipeline_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "decontamination", "mixing", "token_files"]
    deduped = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    kept = {r.doc_id for r in near_duplicates.near_duplicates(docs).filter("kept").collect()}
    assert sorted(r.doc_id for r in deduped.select("doc_id").collect()) == sorted(kept)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = corpus_pipeline.decontaminate(spark, docs, sf_dir)
    found = decontamination.decontaminate(docs, items).filter("not contaminated")
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == sorted(r.doc_id for r in found.collect())
    assert corpus_pipeline.mix(spark, docs, sf_dir).count() == docs.count()
    result = corpus_pipeline.run(spark, sf_dir).collect()
    result.sort(key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(result, result[1:])) and result[0].start == 0


def test_near_dedup_keeps_one_row_of_a_class(spark, sf_dir):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text, "en", "a", 1, "x")] * 3 + [(6, text, "en", "a", 1, "x"), (7, "other text of its own", "en", "a", 1, "x")]
    rows += [(None, "a text whose ids are all null " * 3, "en", "a", 1, "x")] * 4
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, FIELDS).repartition(3), sf_dir)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 5, 7] and len(out.columns) == 6


def test_names_that_clash_with_inner_ones(spark, sf_dir):
    """Columns of the documents keep their values, whatever they are called."""
    names = ["of_text", "of_id", "gone_id", "gone_text", "row", "tie", "mix_row", "mix_group", "part", "slot", "place", "block", "nth", "row_number", "text_hash"]
    fields = FIELDS.replace(", gone_id string", "") + "".join(f", {n} long" for n in names)
    rows = [(i // 2, f"some words of number {i // 2} and then some more of them", "en", f"src{i % 3}", 1, *range(i, i + len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, fields)
    mixed = corpus_pipeline.mix(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == sorted(rows)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows)
    assert len({r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()}) == corpus_pipeline.near_dedup(spark, docs, sf_dir).count() > 0
