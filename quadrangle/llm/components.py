"""Connected components of a table of links, by rounds of large-star and
small-star: every node ends linked to the smallest node of its component.

Each round is two grouped minima and two joins over the links that are left;
the rounds grow with the logarithm of a component's diameter, not its size.
Rounds end when the links no longer change, which a count and a sum of hashes
tell; no link comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """``directed`` (u, v): u's neighbours v.  Large star links each larger
    neighbour to the smallest one; small star links the smaller ones and u."""
    least = directed.groupBy("u").agg(F.min("v").alias("m"))
    both = directed.join(least.withColumn("m", F.least("m", "u")), "u")
    if large:
        return both.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    lower = both.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b), both long -> (node, component) for the nodes that
    have a link, component being the smallest node reachable.  Links with a
    null end and from a node to itself don't count; no links, no rows."""
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(ordered, "links")
    state = _state(now)
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        star = materialize(_star(both, True).distinct(), "large-star")
        now = materialize(_star(star.select(F.col("a").alias("u"), F.col("b").alias("v")), False).filter("a <> b").distinct(), "small-star")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"links still change after {most_rounds} rounds")
    tops = now.select(F.col("b").alias("node")).distinct()
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(tops.select("node", F.col("node").alias("component"))))
