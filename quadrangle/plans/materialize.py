"""Cut lineage by writing a table into the shared checkpoint folder.

``materialize(df)`` writes ``df`` as parquet under the folder the cluster
names in ``spark.checkpoint.dir`` (never a machine-local temp folder) and
returns a DataFrame reading it back.  Compared with ``Dataset.checkpoint()``
the write is columnar and compressed, and later reads prune columns and
push filters.  Written files survive executor loss; a lost task of a
downstream stage re-reads them instead of recomputing the lineage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by :func:`cleanup`."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/quadrangle-tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "m") -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def cleanup(spark: SparkSession) -> bool:
    """Delete all tables that this application has materialized - at its end,
    or as soon as no DataFrame made from them is read any more."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/quadrangle-tables/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
