from pyspark.sql import functions as F

from tallymark.llm.mixing import mix_sources, mixed_documents


def test_targets_and_bounds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn(
        "source", F.concat(F.lit("s"), F.least(F.col("doc_id") % 20, F.lit(4)))
    )
    mix = mix_sources(docs)
    rows = mix.collect()
    assert len(rows) == docs.count()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(docs.repartition(5)).collect()))
    sources = {r.doc_id: r.source for r in docs.collect()}
    taken, target, size = {}, {}, {}
    for r in rows:
        s = sources[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        size[s] = size.get(s, 0) + r.size
        target[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size >= r.size
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    largest = max(r.size for r in rows)
    for s in size:
        assert target[s] <= 2 * size[s] and abs(taken[s] - target[s]) <= largest
    # One weight for all sources that stay below twice their size.
    order = sorted(size)
    open_ = {s: target[s] / (5, 2, 1)[i % 3] for i, s in enumerate(order) if target[s] < 2 * size[s]}
    assert max(open_.values()) - min(open_.values()) < 1e-6 * max(open_.values())


def test_chances_are_unequal(spark):
    rows = [(i, "w " * (2 if i % 2 else 300), "a") for i in range(2000)] + [(9999, "w " * 900_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs, percent=25).where("source_size < 500000").groupBy("size").agg(F.avg("copies"))
    short, long = (r[1] for r in sorted(got.collect()))
    assert short > 1.5 * long


def test_odd_rows(odd, none):
    got = mix_sources(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert len({r.target for r in rows if r.doc_id in (2, 5, 8)}) == 1  # the null source
    assert mix_sources(none).count() == 0
    mixed = mixed_documents(odd)
    assert mixed.columns[: len(odd.columns)] == odd.columns and len(mixed.columns) == len(odd.columns) + 1
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts[3] == 1 and counts[4] == 1
    assert mixed_documents(none).count() == 0
