"""The pipeline's stages against what their operators say of each input."""

import collections

import corpus_pipeline as P
from quadrangle.llm import decontaminate, quality, simhash_dedup, source_mix

SF = "/root/testdata/sf0.001"


def test_stages_in_order_on_their_predecessors_rows(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == list(P.COLUMNS)
        out.write.parquet(f"{tmp_path}/{i}")
        kept.append(docs)
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    ids = [collections.Counter(r.doc_id for r in d.select("doc_id").collect()) for d in [*kept, docs]]
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    good = {r.doc_id for r in quality.quality_scores(kept[0], labels).filter("predicted = 1").collect()}
    assert set(ids[1]) == good
    one = {r.component_id for r in simhash_dedup.simhash_dedup(kept[1]).collect()}
    assert set(ids[2]) == one
    leaked = {r.doc_id for r in decontaminate.contamination(kept[2], bench).collect()}
    assert set(ids[3]) == set(ids[2]) - leaked
    assert ids[4] == ids[3] == ids[5]
    mixed = [r.doc_id for r in source_mix.mix(kept[3]).orderBy("mix_slot", "mix_rank").collect()]
    assert [r.doc_id for r in docs.orderBy("start").collect()] == mixed
    assert [tuple(r) for r in P.run(spark, SF).orderBy("start").collect()] == [tuple(r) for r in docs.orderBy("start").collect()]


def stages_one_by_one(spark, sf):
    """The ids after each stage, from the operators' own query results."""
    docs = P.pick(spark.read.parquet(f"{sf}/documents.parquet"), **P.COLUMNS)
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    scores = {(r.doc_id, r.predicted) for r in quality.quality_scores(docs, labels).collect()}
    good = {i for i, p in scores if p}
    docs = docs.filter(docs.doc_id.isin([i for i in good if i is not None]) | (docs.doc_id.isNull() if None in good else docs.doc_id.isNull() & False))
    near = simhash_dedup.simhash_dedup(docs).collect()
    gone = {r.doc_id for r in near if r.doc_id is not None and r.doc_id != r.component_id}
    found = {r.doc_id for r in decontaminate.contamination(docs, bench).collect()}
    return sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in gone | found)


def test_odd_rows_and_clashing_columns(spark, tmp_path, odd):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        given = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
        rows = odd.unionByName(given.withColumn("doc_id", F.col("doc_id") + 100)).withColumn("Text", F.lit("clash")).withColumn("key", F.lit("clash"))
        rows.write.parquet(f"{tmp_path}/documents.parquet")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        got = P.run(spark, str(tmp_path)).collect()
        want = stages_one_by_one(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert sorted(str(r.doc_id) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and all(n >= 1 for _, n in starts)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_scratch_tables_are_cleaned_up(spark):
    import os

    from quadrangle.llm.common import scratch_path

    path = scratch_path(spark, "x")
    assert f"/quadrangle-tables/{spark.sparkContext.applicationId}/" in path and not os.path.exists(path)
