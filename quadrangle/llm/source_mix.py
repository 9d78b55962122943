"""Mixing sources to target weights by Pfair scheduling, in SQL functions only.

Time goes in slots, one block of one source each.  In a period of ``Q`` slots
a source with ``q`` of them gets its j-th block (j = 1 .. q) no sooner than
slot floor((j - 1) Q / q) and before slot ceil(j Q / q): its release time and
deadline.  In every slot the released block with the earliest deadline goes
(ties: the first source by name).  As the q sum to Q, no deadline is missed,
so at any slot a source is less than one block off its share.

A source ends when its rows are used up.  The sources that are left share the
slots in proportion to their weights: a new phase.  With n rows and weight w,
source s ends at virtual time n / w, and by virtual time x any other source
has had floor(w x) rows.  A phase's rows of a source are dealt evenly to its
blocks, of ``block_rows`` rows on average over all sources at most, so that
rows, too, follow the weights exactly whatever rounding q has.

A row's place within its source is its rank by the hash of its id.  Ranks
come from counts by (source, hash bucket) and ranks within buckets, so that
no task handles a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick, table

BLOCK_ROWS = 64
#: Slots of a period, about: the precision of q.
PERIOD = 400
#: Rows that a hash bucket of all sources together holds, about.
BUCKET_ROWS = 512
#: The schedule is sent to all tasks up to so many sources, else joined.
SENT_SOURCES = 256
#: Default target weight of a source with n rows: n to this power.
FLATTEN = 0.5


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (key, doc_id, ...) with ``rank``, from 0, within the key."""
    total = rows.count()
    digits = max(1, math.ceil(math.log(max(2, total / BUCKET_ROWS), 16)))
    hashed = rows.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.substring("hash", 1, digits))
    counts = hashed.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("key", "bucket").orderBy("hash", "doc_id")
    return (hashed.withColumn("place", F.row_number().over(within) - 1).join(offsets, ["key", "bucket"])
            .withColumn("rank", F.col("offset") + F.col("place")).drop("hash", "bucket", "place", "offset"))


#: Earliest deadline first over one period: ``qs`` blocks of each source in
#: ``period`` slots -> the slots' (source number, block number), from 0.
_EDF = """
aggregate(sequence(0, period - 1),
  struct(transform(qs, q -> 0) AS done, cast(array() AS array<struct<i: int, j: int>>) AS slots),
  (acc, t) -> transform(
    array(array_min(transform(qs, (q, i) -> IF(acc.done[i] < q AND (acc.done[i] * period) DIV q <= t,
          struct(((acc.done[i] + 1) * period + q - 1) DIV q AS deadline, i AS i, acc.done[i] AS j), NULL)))),
    p -> struct(transform(acc.done, (c, i) -> IF(i = p.i, c + 1, c)) AS done,
                concat(acc.slots, array(struct(p.i AS i, p.j AS j))) AS slots))[0],
  acc -> acc.slots)
"""


def schedule(stats: DataFrame, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """``stats`` (key, n, w): rows and whole-number weight of each source ->
    (key, phases): by phase its first rank, rows, blocks a period, the
    period's slots, periods, first slot, and the slots of its blocks."""
    # One row holds the sources' figures, a few numbers each.
    one = stats.filter("n > 0").agg(F.array_sort(F.collect_list(F.struct("key", "n", "w"))).alias("sources"))
    ends = one.select("sources", F.explode(F.array_sort(F.array_distinct(F.expr("transform(sources, s -> struct(s.n / s.w AS x, s.n AS n, s.w AS w))")))).alias("end"))
    # Equal virtual times (as fractions of different terms) give phases without rows, which go.
    order = Window.orderBy("end")
    cum = ends.select("end", "sources", F.lag("end").over(order).alias("last"))
    had = "IF(s.n / s.w <= {0}.x, s.n, s.w * {0}.n DIV {0}.w)"
    phases = cum.selectExpr("end", f"""transform(sources, s -> struct(s.key AS key, s.w AS w, s.n / s.w >= end.x AS active,
        IF(last IS NULL, 0L, {had.format('last')}) AS lo, {had.format('end')} AS hi)) AS parts""")
    phases = phases.selectExpr("end", "filter(parts, p -> p.active) AS parts").filter("exists(parts, p -> p.hi > p.lo)")
    phases = phases.withColumn("weight", F.expr("aggregate(parts, 0L, (a, p) -> a + p.w)"))
    phases = phases.withColumn("qs", F.expr(f"transform(parts, p -> cast(greatest(1, (2 * p.w * {period} + weight) DIV (2 * weight)) AS int))"))
    phases = phases.withColumn("period", F.expr("aggregate(qs, 0, (a, q) -> a + q)"))
    phases = phases.withColumn("rows", F.expr("aggregate(parts, 0L, (a, p) -> a + p.hi - p.lo)"))
    phases = phases.withColumn("periods", F.expr(f"greatest(1L, (rows + period * {block_rows} - 1) DIV (period * {block_rows}))"))
    before = Window.orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    phases = phases.withColumn("first", F.coalesce(F.sum(F.col("period") * F.col("periods")).over(before), F.lit(0))).withColumn("phase", F.row_number().over(Window.orderBy("end")))
    # The windows above leave one partition of one row a phase; the schedules are made in many.
    made = phases.repartition("phase").withColumn("slots", F.expr(_EDF))
    each = made.select("phase", "period", "periods", "first", "slots", F.posexplode("parts").alias("i", "part"), "qs")
    return (each.select(F.col("part.key").alias("key"), F.struct(
                F.col("part.lo").alias("lo"), F.col("part.hi").alias("hi"), "phase", F.expr("qs[i]").alias("q"), "period", "periods", "first",
                F.expr("filter(transform(slots, (s, t) -> IF(s.i = i, t, NULL)), t -> t IS NOT NULL)").alias("at")).alias("of"))
            .groupBy("key").agg(F.array_sort(F.collect_list("of")).alias("phases")))


def _weights(stats: DataFrame, weights: dict[str, int] | None) -> Column:
    by_size = F.greatest(F.lit(1), F.round(1000 * F.pow(F.col("n").cast("double"), F.lit(FLATTEN)))).cast("long")
    if weights is None:
        return by_size
    if not weights or any(w != int(w) or w < 1 for w in weights.values()):
        raise ValueError("target weights are whole numbers from 1")
    named = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, int(w))])
    return F.coalesce(F.element_at(named, F.col("name")), F.lit(min(weights.values()))).cast("long")


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, carry: list[str] = ()) -> DataFrame:
    """``docs`` (doc_id, source) with mix_phase, mix_slot and mix_rank: rows
    in the order of (mix_slot, mix_rank) are the mix.  No row goes.

    ``weights``: whole-number target weights by source; sources without one
    get the least weight named.  None: the square root of a source's rows.
    Columns named in ``carry`` (found as the others are) go along.

    Nulls: rows with a null source are a source of their own, the last by
    name among weights' ties the first; null ids come as one id.  Rows with
    one id keep places of their own.  An empty table gives an empty result.
    Other columns are ignored."""
    extra = {c: dict(docs.dtypes)[c] for c in carry}
    rows = pick(docs, doc_id="long", source="string", **extra).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    ranked = _ranked(rows)
    stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("source").alias("name"))
    stats = materialize(stats.withColumn("w", _weights(stats, weights)).select("key", "n", "w"), "mix-sources")
    plan = materialize(schedule(stats, block_rows), "mix-schedule")
    plan = F.broadcast(plan) if stats.count() <= SENT_SOURCES else plan
    placed = (ranked.join(plan, "key")
              .withColumn("of", F.expr("filter(phases, p -> p.lo <= rank AND rank < p.hi)[0]"))
              .withColumn("block", F.expr("(rank - of.lo) * (of.q * of.periods) DIV (of.hi - of.lo)")))
    return placed.select("doc_id", "source", *carry, F.col("of.phase").alias("mix_phase"),
                         F.expr("of.first + (block DIV of.q) * of.period + of.at[cast(block % of.q AS int)]").alias("mix_slot"),
                         F.col("rank").alias("mix_rank"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
