"""The corpus pipeline: documents through the operators of quadrangle.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrangle.llm import decontaminate, quality, simhash_dedup, source_mix, token_output
from quadrangle.llm.common import pick, ready, scratch_path, table

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Nulls: a null text counts as empty and is decided like one; other nulls
    stay as they are.  Repeated rows are each decided, alike.  An empty table
    stays empty.  Other columns go, whatever their names."""
    return quality.keep_good(pick(docs, **COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Nulls: texts that are null, empty or blank have fingerprint zero and are
    one group.  Of a group the smallest doc_id stays; rows that repeat an id
    stay or go together, and rows without an id stay.  An empty table stays
    empty."""
    ready(spark)
    return simhash_dedup.keep_one(pick(docs, **COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Nulls: a null text holds none, and null items are none.  Repeated rows go
    or stay together.  An empty table, or benchmark, changes nothing."""
    return decontaminate.decontaminate(pick(docs, **COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of their sources.

    Nulls: a null source is one of its own.  Rows that repeat an id are each
    given a place.  An empty table stays empty."""
    ready(spark)
    mixed = source_mix.mix(pick(docs, **COLUMNS), carry=["text", "lang", "n_chars"])
    return mixed.repartitionByRange("mix_slot", "mix_rank").sortWithinPartitions("mix_slot", "mix_rank").select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token file of the documents in the order that the mix has written them
    in; what the file holds, per document, as read back.

    Nulls: a null text is an empty one and has the end id alone; null ids are
    kept.  Repeated rows are each written.  An empty table gives no rows."""
    ready(spark)
    path = scratch_path(spark, "pipeline-tokens")
    token_output.write_tokens(docs, path, order_by=token_output.written_order(docs))
    return token_output.read_documents(spark, path)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in
    the shared folder and read again as the next stage's documents."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{i}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        else:
            docs = out
    return docs


#: The classifier and the tokenizer can't be put in SQL.
ORACLE_SQL = None
