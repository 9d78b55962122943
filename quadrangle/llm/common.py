"""What the corpus operators share: column picking, task batches, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import materialize  # noqa: F401  (re-exported)
from ..session import ensure_checkpoint_dir, ship_package


def ready(spark: SparkSession) -> None:
    """Shared checkpoint folder known, package importable in Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with only the named columns, cast to the given types.

    Columns are found by exact name first, else by case-insensitive name, and
    by position if the name occurs more than once (the first one counts), so
    other columns with clashing names do no harm."""
    names = df.columns
    flat = df
    if len({n.lower() for n in names}) < len(names):
        flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    at = {}
    for want in columns:
        exact = [i for i, n in enumerate(names) if n == want]
        loose = [i for i, n in enumerate(names) if n.lower() == want.lower()]
        if not loose:
            raise ValueError(f"column {want} is missing; the table has {names}")
        at[want] = (exact or loose)[0]
    return flat.select(*[F.col(f"`{flat.columns[at[n]]}`").cast(t).alias(n)
                         for n, t in columns.items()])


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return pick(docs, doc_id="long", text="string").fillna({"text": ""})


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share, below what
    ``plans.materialize.cleanup`` deletes."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/quadrangle-tables/{spark.sparkContext.applicationId}/llm/{label}-{uuid.uuid4().hex}"


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20
           ) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` holds about ``most_bytes`` in each
    (one row at least): memory stays bounded whatever the batch size is."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        size = col.nbytes
        if size <= most_bytes or batch.num_rows <= 1:
            yield batch
            continue
        step = max(1, batch.num_rows * most_bytes // size)
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
