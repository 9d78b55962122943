"""Hot keys: detect them with a size bound, and salt the joins they hit.

The recurring shape in this library is *annotate each row of a large frame
with a per-key attribute* (the first ``seq`` of its key, whether its parent
exists, the conflict count of its interval class).  The per-key side comes
out of an aggregation, so AQE's skew-join split does not apply (it needs a
plain shuffle on both sides); a key holding a third of all rows would be
joined by a single task.

``heavy_hitters`` picks the keys that hold more than ``min_rows`` rows, what
one task should have, and more than ``total / max_keys``: by construction
there are at most ``max_keys`` of them, so broadcasting that set is safe at
any scale.  Each has a number of salts that goes by its count, one for every
``min_rows`` rows.  ``salted_left_join`` spreads a hot key's rows over its
salts (by a hash of a row column) and replicates only the hot keys' per-key
rows; cold keys join as before.  One pass over the large side,
no change to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialize import materialize

DEFAULT_MAX_KEYS = 100_000
DEFAULT_MIN_ROWS = 200_000


def _limits(spark, max_keys: int, min_rows: int) -> tuple[int, int]:
    conf = spark.conf
    return (int(conf.get("quadrangle.skew.maxKeys", str(max_keys))),
            int(conf.get("quadrangle.skew.minRows", str(min_rows))))


def heavy_hitters_many(frames: list[tuple[DataFrame, list[str], str]],
                       max_keys: int = DEFAULT_MAX_KEYS, min_rows: int = DEFAULT_MIN_ROWS
                       ) -> list[DataFrame | None]:
    """:func:`heavy_hitters` for several per-key frames in one small job (the
    totals and largest counts of all frames come back together)."""
    if not frames:
        return []
    spark = frames[0][0].sparkSession
    max_keys, min_rows = _limits(spark, max_keys, min_rows)
    stats = None
    for i, (counts, _, count_col) in enumerate(frames):
        one = counts.agg(F.lit(i).alias("_i"), F.sum(count_col).alias("_t"),
                         F.max(count_col).alias("_m"))
        stats = one if stats is None else stats.unionByName(one)
    got = {r["_i"]: (r["_t"], r["_m"]) for r in stats.collect()}
    out = []
    for i, (counts, on, count_col) in enumerate(frames):
        total, largest = got.get(i, (None, None))
        threshold = max(float(min_rows), (total or 0) / float(max_keys))
        if largest is None or largest <= threshold:
            out.append(None)
        else:
            out.append(counts.filter(F.col(count_col) > threshold).select(
                *on, (F.ceil(F.col(count_col) / F.lit(min_rows)) + 1).cast("int").alias("_salts")))
    return out


def heavy_hitters(counts: DataFrame, on: list[str], count_col: str,
                  max_keys: int = DEFAULT_MAX_KEYS, min_rows: int = DEFAULT_MIN_ROWS
                  ) -> DataFrame | None:
    """Keys whose ``count_col`` exceeds ``max(min_rows, total / max_keys)`` -
    at most ``max_keys`` of them - or ``None`` when no key does (the common
    case: then no salting is needed).  One small job: total and largest
    count come back as two scalars.  The session settings
    ``quadrangle.skew.minRows`` / ``maxKeys`` override the defaults."""
    return heavy_hitters_many([(counts, on, count_col)], max_keys, min_rows)[0]


def salted_left_join(big: DataFrame, per_key: DataFrame, on: list[str], hot: DataFrame | None,
                     spread: Column, how: str = "left") -> DataFrame:
    """``big JOIN per_key USING (on)`` (``how`` = left / inner / left_semi /
    left_anti), with the rows of each of the ``hot`` keys spread over its
    ``_salts`` tasks.
    ``spread`` is a column of ``big`` that varies within a key (e.g. ``seq``);
    ``hot`` must be bounded (see :func:`heavy_hitters`)."""
    if hot is None:
        return big.join(per_key, on, how)
    marks = F.broadcast(hot.select(*on, "_salts"))
    b = big.join(marks, on, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_salts")))
        .otherwise(F.lit(0)).cast("int")).drop("_salts")
    p = per_key.join(marks, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return b.join(p, [*on, "_salt"], how).drop("_salt")


def annotate(big: DataFrame, per_key: DataFrame, on: list[str], count_col: str, spread: Column,
             skew_safe: bool = True, max_keys: int = DEFAULT_MAX_KEYS,
             min_rows: int = DEFAULT_MIN_ROWS, checkpoint: bool = True) -> DataFrame:
    """Left-join ``per_key`` (one row per key, with the number of ``big`` rows
    of the key in ``count_col``) onto ``big``, salting the hot keys.

    ``checkpoint`` writes ``per_key`` once (shared ``spark.checkpoint.dir``)
    so the detection job and the join do not both recompute it - worth it
    when ``per_key`` is an aggregate over an expensive lineage; pass False
    when ``big`` is itself already materialized."""
    if not skew_safe:
        return big.join(per_key.drop(count_col), on, "left")
    if checkpoint:
        per_key = materialize(per_key, "per-key")
    hot = heavy_hitters(per_key, on, count_col, max_keys, min_rows)
    return salted_left_join(big, per_key.drop(count_col), on, hot, spread)


def annotate_many(big: DataFrame, frames: list[tuple[DataFrame, list[str]]], count_col: str, spread: Column,
                  checkpoint: bool = True) -> DataFrame:
    """:func:`annotate` by several keys, with the totals and largest counts of
    all of them found in one job."""
    if checkpoint:
        frames = [(materialize(per_key, "per-key"), on) for per_key, on in frames]
    hots = heavy_hitters_many([(per_key, on, count_col) for per_key, on in frames])
    for (per_key, on), hot in zip(frames, hots):
        big = salted_left_join(big, per_key.drop(count_col), on, hot, spread)
    return big
