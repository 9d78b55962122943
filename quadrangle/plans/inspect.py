"""Plan inspection helpers (used by the plan-shape tests and when tuning):
the optimized logical plan and the physical plan as text, and checks for
the node kinds that must not appear in a scalable plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

UNSCALABLE = ("CartesianProduct", "BroadcastNestedLoopJoin")


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def logical(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def unscalable_nodes(df: DataFrame) -> list[str]:
    """Nested-loop / cartesian joins present in the physical plan."""
    p = physical(df)
    return [n for n in UNSCALABLE if n in p]


def pushed_filters(df: DataFrame) -> list[str]:
    """The ``PushedFilters`` of every parquet scan."""
    out = []
    for line in physical(df).splitlines():
        i = line.find("PushedFilters: [")
        if i >= 0:
            out.append(line[i + 16:line.find("]", i)])
    return out
