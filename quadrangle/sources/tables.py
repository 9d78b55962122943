"""The campus tables as stored parquet, read with their fixed schema.

``CampusTables`` offers the same attributes as the fixture adapter
(``departements``, ``etudiants``, ...), so every operator and registered
query runs unchanged over stored tables.  ``materialize`` writes the
derived fixture tables once (each table its own parquet directory), which
is how a deployment would hold them: scans then read only the columns and
row groups a query needs instead of re-deriving the tables per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import SCHEMAS, conform


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One stored table with its fixed ``StructType`` (nothing inferred)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


class CampusTables:
    """Stored campus tables.  With ``database`` given, tables registered there
    (bucketed ones) are read through the catalog so Spark knows their
    bucketing; the others are read from ``root`` with the fixed schema."""

    def __init__(self, spark: SparkSession, root: str, database: str | None = None):
        self.spark = spark
        self.root = root
        self.database = database

    def table(self, name: str) -> DataFrame:
        if self.database and self.spark.catalog.tableExists(f"{self.database}.{name}"):
            return conform(self.spark.table(f"{self.database}.{name}"), name)
        return read_table(self.spark, self.root, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)


# Fact tables joined and aggregated by student: bucketing them alike on
# etudiant_id lets those joins and the first aggregation level read
# co-partitioned files without a shuffle.
STUDENT_BUCKETED = {"notes": ["etudiant_id"], "absences": ["etudiant_id"],
                    "inscriptions": ["etudiant_id"]}


def materialize(campus, root: str, names=None, partition_by: dict | None = None,
                buckets: int | None = None, database: str | None = None,
                bucket_by: dict | None = None) -> str:
    """Write ``campus``'s tables under ``root`` (one directory per table).

    ``partition_by`` may name a partition column per table (partition
    pruning).  With ``buckets`` and ``database``, the tables in
    ``bucket_by`` (default: the student-keyed facts) are written as bucketed
    tables (``bucketBy(buckets, key).sortBy(key)``) registered in
    ``database``, their files still under ``root``."""
    partition_by = partition_by or {}
    bucket_by = STUDENT_BUCKETED if bucket_by is None else bucket_by
    if buckets and database:
        campus.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} "
                         f"LOCATION '{root.rstrip('/')}/_catalog'")
    for name in names or SCHEMAS:
        df = conform(campus.table(name), name)
        path = f"{root.rstrip('/')}/{name}"
        w = df.write.mode("errorifexists")
        if name in partition_by:
            w = w.partitionBy(partition_by[name])
        if buckets and database and name in bucket_by:
            keys = bucket_by[name]
            (w.bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
             .saveAsTable(f"{database}.{name}"))
        else:
            w.parquet(path)
    return root
