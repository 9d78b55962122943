"""Connected components of a graph of long ids, by joins and aggregations.

Alternating star rounds: first every node's larger neighbours are hung on its
smallest one (large star), then its smaller neighbours and itself (small
star).  Paths halve, so a chain of n nodes takes a number of rounds that goes
with the logarithm of n.  Each round is one written table; hot nodes - the
middle of a star with most of the edges - are joined salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialize
from .skew import annotate


def _stars(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the least neighbour or self ``m`` of ``a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
    return annotate(edges, least, ["a"], "_n", F.col("b"), checkpoint=False).withColumn("m", F.least("a", "m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _stars(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # a > b
    small = _stars(materialize(large, "components"))
    hung = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(small.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` is
    linked to.  Nodes without an edge to another one aren't in the result."""
    pair = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    cur, before = materialize(pair.filter("a <> b").distinct(), "components"), None
    while True:
        # Two numbers come back: where they stay the same, so do the edges.
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % (1 << 40)).cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        cur, before = materialize(_round(cur), "components"), now
    roots = cur.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
