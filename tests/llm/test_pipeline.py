"""The stages one by one on small tables, and the contract of the registered queries."""

import corpus_pipeline
from tallymark.llm import decontam, queries


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.store(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
        if name == "line_dedup":
            assert docs.count() == before.count()
    assert decontam.contaminated(docs, benchmark).count() == 0
    mixed = corpus_pipeline.mix(spark, docs, sf)
    sizes = mixed.groupBy("doc_id").count()
    assert sizes.where("count > 2").count() == 0


def test_odd_and_empty_tables(spark, sf, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.store(stage(spark, docs, sf), f"odd-{name}")
        assert docs.columns[: len(odd.columns)] == odd.columns


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "decontamination", "mixing",
    ]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
