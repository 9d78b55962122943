"""Insert-or-ignore into a large stored table (S4, J11) by key filters.

Beside the data files stand their key filters: a bit table of fixed size for
each file, with ``PROBES`` bits set for every key in it, made when the file is
written.  An incoming batch is probed against the filters, and only the files
that may hold one of its keys are read for the exact anti join.  A filter that
is full, or a file without one, lets everything through, so filters decide
what is read and never the result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits set for a key; bits of a filter are in blocks of 32,768 (4 KB).
PROBES = 2
BLOCK = 32_768


@dataclass
class Inserted:
    """What an insert did: rows put in, data files before it and those read."""
    rows: int
    files: int
    files_read: int


def _normal(path: str) -> Column:
    """A path with one slash after its scheme, as listings and scans differ."""
    return F.regexp_replace(F.col(path), "^([a-z0-9]+):/+", "$1:/")


class KeyFilteredTable:
    """A table of parquet files under ``path`` with unique ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bits: int = 1 << 20):
        if bits % BLOCK:
            raise ValueError(f"bits must be a multiple of {BLOCK}")
        self.spark, self.path, self.keys, self.bits = spark, path.rstrip("/"), keys, bits

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _places(self) -> list[Column]:
        """1-based bit places of a key."""
        h = F.xxhash64(*self.keys)
        return [F.pmod(F.shiftright(h, 32 * i), F.lit(self.bits)) + 1 for i in range(PROBES)]

    def read(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/data")

    def append(self, rows: DataFrame) -> None:
        """Write ``rows`` as new files, then the filters of these files."""
        batch = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{batch}")
        new = self.spark.read.parquet(f"{self.path}/data/{batch}").select(*self.keys, _normal("_metadata.file_path").alias("file"))
        places = new.select("file", F.explode(F.array(*self._places())).alias("at"))
        (places.select("file", F.bitmap_bucket_number("at").alias("block"), F.bitmap_bit_position("at").alias("bit"))
         .groupBy("file", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
         .write.parquet(f"{self.path}/filters/{batch}"))

    def filters(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/filters")

    def files(self) -> DataFrame:
        """(path, file) of the data files, by the table's listing."""
        listed = self.spark.createDataFrame([(f,) for f in sorted(self.read().inputFiles())], "path string")
        return listed.withColumn("file", _normal("path"))

    def candidates(self, batch: DataFrame) -> DataFrame:
        """Files that may hold a key of ``batch``: those where all bits of one
        are set, and those without a filter."""
        has_null = F.greatest(*[F.col(k).isNull().cast("int") for k in self.keys], F.lit(0)) == 1
        probes = batch.select(*self.keys).filter(~has_null).distinct().select(
            F.xxhash64(*self.keys).alias("key"), F.posexplode(F.array(*self._places())).alias("probe", "at"))
        probes = probes.select("key", "probe", F.bitmap_bucket_number("at").alias("block"), F.bitmap_bit_position("at").cast("int").alias("bit"))
        byte = F.conv(F.hex(F.expr("substring(bits, bit DIV 8 + 1, 1)")), 16, 10).cast("int")
        hit = probes.join(self.filters(), "block").filter(F.getbit(byte, F.col("bit") % 8) == 1)
        may = hit.groupBy("file", "key").agg(F.count_distinct("probe").alias("n")).filter(F.col("n") == PROBES).select("file").distinct()
        files = self.files()
        return (files.join(may, "file", "left_semi")
                .unionByName(files.join(self.filters().select("file").distinct(), "file", "left_anti")).select("path"))

    def insert_ignore(self, batch: DataFrame, seq: str) -> Inserted:
        """Add the rows of ``batch`` whose key isn't there; of rows with one
        key the first by ``seq``.  Rows with a NULL in the key all go in."""
        if not self._exists(f"{self.path}/data"):
            self.append(batch.limit(0).drop(seq))
        null = F.greatest(*[F.col(k).isNull().cast("int") for k in self.keys], F.lit(0)) == 1
        others = [c for c in batch.columns if c not in self.keys]
        first = (batch.filter(~null).groupBy(*self.keys).agg(F.min_by(F.struct(*others), F.col(seq)).alias("_r"))
                 .select(*self.keys, *[F.col("_r")[c].alias(c) for c in others]))
        files = len(self.read().inputFiles())
        # One name for each file that must be read: what a scan's plan holds as well.
        wanted = [r.path for r in self.candidates(batch).collect()]
        if wanted:
            held = self.spark.read.schema(self.read().schema).parquet(*wanted).select(*self.keys)
            first = first.join(held.distinct(), self.keys, "left_anti")
        fresh = first.unionByName(batch.filter(null)).drop(seq)
        before = self.read().count()
        self.append(fresh)
        return Inserted(self.read().count() - before, files, len(wanted))
