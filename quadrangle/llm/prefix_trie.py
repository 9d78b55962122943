"""Trie of conversation prefixes with subtree totals.

Marks.  A turn has two hashes below the prime 2^61 - 1, a prefix of turns two
polynomial marks over them (122 bits).  Marks of pieces combine by powers of
the base, so conversations are dealt by ranges of (conv_id, turn): one that
spans several ranges is put together from the ranges' marks, and no text
moves at all.

Nodes.  Rows with the same depth and mark are one node.  A node with a single
member has one leaf below it, saves nothing, and its ends are its member's;
only nodes with several members, and the root, take part in what follows.

Totals by time-forward processing.  Nodes are dealt to shards by blocks of
conv_id, sorted by reverse level order (Spark's external sort), and read once:
a node adds what the queue holds for it to its own numbers and puts the sum
into the queue for its parent, whose turn comes later.  The queue keeps
``HELD`` messages in memory and spills the rest in sorted runs.  What goes to
a parent in another shard is added up by Spark and passed on in the next
round, until nothing crosses: rounds go by how often a path from a leaf to
the root changes shards, not by its length.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.skew import annotate
from .common import fold, materialize, pick, ready, table

PRIME = (1 << 61) - 1
BASES = (1_000_003_000_017, 7_777_000_333_111)
_BACK = tuple(pow(b, -1, PRIME) for b in BASES)
#: conv_ids that share their first turns, and lie in one shard.
SPAN = 100
MOST_SHARED = 5
#: Messages of a queue that are held in memory.
HELD = 200_000
#: Bytes of ids that are strung together in one row.
CHUNK = 1 << 20

# -- the queue ------------------------------------------------------------------

_MESSAGE = struct.Struct("<qqqqq")


class _Run:
    """A sorted run of messages in a file of the task, read block by block."""

    def __init__(self, messages: list[tuple]):
        self.file = tempfile.TemporaryFile()
        self.file.write(b"".join(_MESSAGE.pack(*m) for m in messages))
        self.file.seek(0)
        self.block, self.at = [], 0
        self.advance()

    def advance(self) -> None:
        self.at += 1
        if self.at >= len(self.block):
            self.block, self.at = list(_MESSAGE.iter_unpack(self.file.read(_MESSAGE.size * 4096))), 0

    @property
    def head(self) -> tuple | None:
        return self.block[self.at] if self.block else None


class SpillingQueue:
    """A priority queue of (level, mark, mark, leaves, saved), least first,
    that holds ``held`` of them in memory; beyond that the later half goes to
    a sorted run, and many runs become one."""

    def __init__(self, held: int = HELD, most_runs: int = 32):
        self.heap, self.runs, self.held, self.most_runs = [], [], held, most_runs

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self.heap.sort()
            half = len(self.heap) // 2
            self.runs.append(_Run(self.heap[half:]))
            del self.heap[half:]
            if len(self.runs) > self.most_runs:
                self._merge()

    def _merge(self) -> None:
        def left(run: _Run) -> Iterator[tuple]:
            while run.head:
                yield run.head
                run.advance()

        made = _Run([])
        for m in heapq.merge(*map(left, self.runs)):
            made.file.write(_MESSAGE.pack(*m))
        made.file.seek(0)
        made.advance()
        self.runs = [made]

    def take(self, key: tuple) -> tuple[int, int]:
        """Sums of the messages for ``key``, which are removed; those before
        it must have been taken."""
        leaves = saved = 0
        while self.heap and self.heap[0][:3] == key:
            m = heapq.heappop(self.heap)
            leaves, saved = leaves + m[3], saved + m[4]
        for run in self.runs:
            while run.head and run.head[:3] == key:
                leaves, saved = leaves + run.head[3], saved + run.head[4]
                run.advance()
        return leaves, saved

    def __len__(self) -> int:
        return len(self.heap) + sum(run.head is not None for run in self.runs)


# -- turns and their marks --------------------------------------------------------

_TURNS = "part int, conv_id long, pos long, n_chars long, v1 long, v2 long, h1 long, h2 long"


def _local_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, conv, pos, a, b = TaskContext.get().partitionId(), None, 0, 0, 0
    for batch in batches:
        at, first, second = [], [], []
        for c, v, w in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "v1", "v2"))):
            if c != conv:
                conv, pos, a, b = c, 0, 0, 0
            pos, a, b = pos + 1, (a * BASES[0] + v) % PRIME, (b * BASES[1] + w) % PRIME
            at.append(pos)
            first.append(a)
            second.append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(at), pa.int32()), batch.column("conv_id"), pa.array(at, pa.int64()), batch.column("n_chars"), batch.column("v1"),
             batch.column("v2"), pa.array(first, pa.int64()), pa.array(second, pa.int64())],
            names=["part", "conv_id", "pos", "n_chars", "v1", "v2", "h1", "h2"])


def _carried(ends: list) -> dict[int, tuple]:
    """Per range whose first conversation began earlier: its id, and the
    number and marks of its turns before."""
    out, conv, n, marks = {}, None, 0, (0, 0)
    for r in sorted(ends, key=lambda r: r.part):
        last = r.last
        if conv is not None and r.first == conv:
            out[r.part] = (conv, n, *marks)
        if conv is not None and r.first == conv == last.conv_id:
            marks = tuple((m * pow(b, last.pos, PRIME) + h) % PRIME for m, b, h in zip(marks, BASES, (last.h1, last.h2)))
            n += last.pos
        else:
            conv, n, marks = last.conv_id, last.pos, (last.h1, last.h2)
    return out


def _with_carried(carried: dict[int, tuple]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, convs = batch.column("part").to_numpy(), batch.column("conv_id").to_numpy()
            cols = {n: batch.column(n).to_numpy().copy() for n in ("pos", "h1", "h2")}
            for p in set(np.unique(parts).tolist()) & set(carried):
                conv, n, *marks = carried[p]
                for i in np.flatnonzero((parts == p) & (convs == conv)).tolist():
                    k = int(cols["pos"][i])
                    for name, m, b in zip(("h1", "h2"), marks, BASES):
                        cols[name][i] = (m * pow(b, k, PRIME) + int(cols[name][i])) % PRIME
                    cols["pos"][i] = n + k
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(cols["pos"]), *[batch.column(n) for n in ("n_chars", "v1", "v2")],
                                              pa.array(cols["h1"]), pa.array(cols["h2"])], names=["conv_id", "pos", "n_chars", "v1", "v2", "h1", "h2"])
    return run


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n_chars, v1, v2, h1, h2): every turn with its place in
    its conversation from 1 on, its hashes and the marks of the turns up to
    it."""
    rows = (pick(conversations, conv_id="long", turn="long", role="string", text="string").fillna({"role": "", "text": ""}).dropna(subset=["conv_id"]))
    value = lambda k: (F.pmod(F.xxhash64(F.lit(k), "role", "text"), F.lit(PRIME - 1)) + 1)
    rows = rows.select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"), value(1).alias("v1"), value(2).alias("v2"),
                       F.rand(13).alias("_r"))  # deals out repeated rows, which are alike
    order = ["conv_id", "turn", "v1", "v2", "_r"]
    made = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "n_chars", "v1", "v2")
                       .mapInArrow(_local_marks, _TURNS), "turns")
    # Two rows' numbers for each range, however long the table.
    ends = made.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos", "h1", "h2")).alias("last")).collect()
    return made.mapInArrow(_with_carried(_carried(ends)), _TURNS.split(", ", 1)[1])


# -- sequences: the rows that the trie is made of -----------------------------------

_SEQUENCES = "conv_id long, depth long, n_chars long, h1 long, h2 long, p1 long, p2 long, last boolean"


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of turns whose conversation's beginning was replaced: d1 and d2
    are the new beginning's marks less the old one's, k the turns since; the
    marks of the prefix without the turn come beside."""
    powers = [[1], [1]]
    for n, b in zip((0, 1), BASES):
        for _ in range(1023):
            powers[n].append(powers[n][-1] * b % PRIME)
    for batch in batches:
        ks, out = batch.column("k").to_pylist(), []
        for i in (0, 1):
            base, back, table_ = BASES[i], _BACK[i], powers[i]
            h, p = [], []
            for m, d, v, k in zip(batch.column(f"h{i + 1}").to_pylist(), batch.column(f"d{i + 1}").to_pylist(), batch.column(f"v{i + 1}").to_pylist(), ks):
                if d:
                    m = (m + d * (table_[k] if k < 1024 else pow(base, k, PRIME))) % PRIME
                h.append(m)
                p.append((m - v) * back % PRIME)
            out += [pa.array(h, pa.int64()), pa.array(p, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), batch.column("n_chars"), out[0], out[2], out[1], out[3], batch.column("last")],
                                         names=["conv_id", "depth", "n_chars", "h1", "h2", "p1", "p2", "last"])


def plain(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences and (conv_id, length) of conversations as they are."""
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("length"))
    zero = F.lit(0).cast("long")
    seq = (annotate(rows, convs.withColumn("n", F.col("length")), ["conv_id"], "n", F.col("pos"))
           .select("conv_id", F.col("pos").alias("depth"), "n_chars", "v1", "v2", "h1", "h2", zero.alias("d1"), zero.alias("d2"), zero.alias("k"),
                   (F.col("pos") == F.col("length")).alias("last")))
    return seq.mapInArrow(_shifted, _SEQUENCES), convs


def rebuilt(rows: DataFrame, shared: Column, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Sequences and (conv_id, length) of conversations whose first
    ``shared`` turns (0 to ``MOST_SHARED``, a column of conv_id) are those of
    the first conversation of their block of ``span`` ids: all of them if it
    has fewer, none if it isn't there.  Negative ids are in blocks that begin
    below them, too."""
    numbers = range(1, MOST_SHARED + 1)
    first = [F.max(F.when(F.col("pos") == j, F.struct("n_chars", "v1", "v2", "h1", "h2"))).alias(f"t{j}") for j in numbers]
    heads = materialize(rows.groupBy("conv_id").agg(F.count("*").alias("n"), *first), "heads")
    base = heads.filter(F.pmod("conv_id", F.lit(span)) == 0).select(
        F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.array(*[f"t{j}" for j in numbers]).alias("base_turns"))
    at = lambda turns_, j, mark: F.when(j > 0, F.try_element_at(turns_, j.cast("int"))[mark]).otherwise(F.lit(0).cast("long"))
    shares, mine, theirs = F.col("shares"), F.array(*[f"t{j}" for j in numbers]), F.col("base_turns")
    convs = (heads.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(span))).withColumn("shares", shared.cast("long"))
             .join(base, "base", "left")
             .withColumn("taken", F.least(shares, F.coalesce("base_n", F.lit(0).cast("long"))))
             .withColumn("length", F.col("taken") + F.greatest(F.col("n") - shares, F.lit(0).cast("long"))))
    for i in (1, 2):
        # Where no turn of its own stays, the difference isn't used.
        convs = convs.withColumn(f"d{i}", F.pmod(at(theirs, F.col("taken"), f"h{i}") - F.coalesce(at(mine, shares, f"h{i}"), F.lit(0).cast("long")), F.lit(PRIME)))
    convs = materialize(convs.select("conv_id", "n", "shares", "taken", "length", "d1", "d2", "base_turns"), "convs")
    zero = F.lit(0).cast("long")
    before = (convs.filter("taken > 0").select("conv_id", "length", F.posexplode(F.slice("base_turns", 1, F.col("taken").cast("int"))).alias("i", "t"))
              .select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "t.n_chars", "t.v1", "t.v2", "t.h1", "t.h2", zero.alias("d1"), zero.alias("d2"),
                      zero.alias("k"), (F.col("i") + 1 == F.col("length")).alias("last")))
    depth = F.col("pos") - shares + F.col("taken")
    own = (annotate(rows, convs.drop("base_turns"), ["conv_id"], "n", F.col("pos"), checkpoint=False).filter(F.col("pos") > shares)
           .select("conv_id", depth.alias("depth"), "n_chars", "v1", "v2", "h1", "h2", "d1", "d2", (F.col("pos") - shares).alias("k"),
                   (depth == F.col("length")).alias("last")))
    return before.unionByName(own).mapInArrow(_shifted, _SEQUENCES), convs.select("conv_id", "length")


# -- totals -------------------------------------------------------------------------

_SENT = "kind int, shard int, depth long, h1 long, h2 long, leaves long, saved long"
_TOTAL, _CROSSING = 0, 1


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each shard by reverse level order, messages from other shards
    before their node."""
    queue, shard, key, leaves, saved, out = SpillingQueue(), None, None, 0, 0, []
    types = [pa.int32(), pa.int32()] + [pa.int64()] * 5
    names = ["kind", "shard", "depth", "h1", "h2", "leaves", "saved"]
    for batch in batches:
        for r in batch.to_pylist():
            if r["shard"] != shard:
                if len(queue):
                    raise AssertionError("messages are left over in a shard")
                shard, key = r["shard"], None
            here = (-r["depth"], r["h1"], r["h2"])
            if here != key:
                key, leaves, saved = here, 0, 0
            leaves, saved = leaves + r["leaves"], saved + r["saved"]
            if r["is_node"]:
                more = queue.take(here)
                leaves, saved = leaves + more[0], saved + more[1]
                if leaves or saved:
                    out.append((_TOTAL, shard, r["depth"], r["h1"], r["h2"], leaves, saved))
                    if r["p1"] is not None and r["parent_shard"] == shard:
                        queue.push((here[0] + 1, r["p1"], r["p2"], leaves, saved))
                    elif r["p1"] is not None:
                        out.append((_CROSSING, r["parent_shard"], r["depth"] - 1, r["p1"], r["p2"], leaves, saved))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out = []


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(depth, h1, h2, leaves, saved) with the sums of ``leaves`` and
    ``saved`` over each node's subtree; ``nodes`` have depth, h1, h2, p1, p2
    (the parent's marks, null at the root), shard, parent_shard."""
    key = ["depth", "h1", "h2"]
    node = nodes.select("shard", *key, "p1", "p2", "parent_shard", F.lit(True).alias("is_node"), "leaves", "saved")
    silent = node.withColumn("leaves", F.lit(0).cast("long")).withColumn("saved", F.lit(0).cast("long"))
    rows, totals = node, None
    while True:
        sent = materialize(rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "h1", "h2", "is_node").mapInArrow(_forward, _SENT), "totals")
        part = sent.filter(F.col("kind") == _TOTAL).select(*key, "leaves", "saved")
        totals = part if totals is None else totals.unionByName(part)
        crossing = sent.filter(F.col("kind") == _CROSSING)
        if crossing.isEmpty():
            return totals.groupBy(*key).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        null = F.lit(None)
        messages = (crossing.groupBy("shard", *key).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
                    .select("shard", *key, null.cast("long").alias("p1"), null.cast("long").alias("p2"), null.cast("int").alias("parent_shard"),
                            F.lit(False).alias("is_node"), "leaves", "saved"))
        rows = silent.unionByName(messages)


# -- ends -----------------------------------------------------------------------------


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node in a row, in order, cut at ``CHUNK`` bytes."""
    key, ids, size, out = None, [], 0, []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], names=["depth", "h1", "h2", "first", "ids"])
        out.clear()
        return made

    held = 0
    for b in batches:
        for *here, conv in zip(*(b.column(n).to_pylist() for n in ("depth", "h1", "h2", "conv_id"))):
            if here != key or size >= CHUNK:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    held += size
                    if held >= 8 * CHUNK or len(out) >= 20_000:
                        yield batch()
                        held = 0
                key, ids, size = here, [], 0
            ids.append(conv)
            size += 12
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest, out = None, None, []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], names=["depth", "h1", "h2", "ends"])
        out.clear()
        return made

    for b in batches:
        for *here, ids in zip(*(b.column(n).to_pylist() for n in ("depth", "h1", "h2", "ids"))):
            if here != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                    if len(out) >= 20_000:
                        yield batch()
                key, digest = here, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if key is not None:
        out.append((*key, digest.hexdigest()))
        yield batch()


def _ends(ended: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node.  A hash is taken one byte
    after the other, so a node's ids are put in order and strung together in
    many tasks, and only their strings pass through one."""
    key = ["depth", "h1", "h2"]
    return (ended.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_strung, "depth long, h1 long, h2 long, first long, ids string")
            .repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_hashed, "depth long, h1 long, h2 long, ends string"))


# -- the trie ---------------------------------------------------------------------------


def trie(sequences: DataFrame, convs: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each distinct prefix of the sequences, root included:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    key, zero = ["depth", "h1", "h2"], F.lit(0).cast("long")
    sequences = materialize(sequences, "sequences")
    nodes = materialize(sequences.groupBy(*key).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_chars").alias("n_chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.sum(F.col("last").cast("long")).alias("n_ends")), "nodes")
    root = (convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.coalesce(F.sum((F.col("length") == 0).cast("long")), zero).alias("n_ends"))
            .filter("n_convs > 0").select(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "n_convs", "conv_id", zero.alias("n_chars"),
                                          F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "n_ends"))
    children = (nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
                .agg(F.count("*").alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("alone")))
    several = materialize(nodes.filter("n_convs > 1").unionByName(root).join(children.withColumnRenamed("depth", "depth"), key, "left")
                          .fillna({"n_children": 0, "alone": 0}), "shared-nodes")
    above = several.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    under = ["depth", "p1", "p2"]
    alone = annotate(nodes.filter("n_convs = 1"), above, under, "n_children", F.col("h1"), checkpoint=False)
    alone = alone.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"), "n_convs", (1 - F.col("n_ends")).alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
        F.sha2(F.when(F.col("n_ends") == 1, F.col("conv_id").cast("string")).otherwise(F.lit("")).cast("binary"), 256).alias("ends_sha256"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard = lambda c: F.pmod(F.xxhash64(F.floor(F.col(c) / F.lit(span))), F.lit(shards)).cast("int")
    placed = materialize(annotate(several.withColumnRenamed("n_children", "kids"), above, under, "n_children", F.col("h1"), checkpoint=False)
                         .select(*key, "p1", "p2", "n_convs", "conv_id", "parent_conv_id", F.col("kids").alias("n_children"), "n_ends",
                                 shard("conv_id").alias("shard"), shard("parent_conv_id").alias("parent_shard"),
                                 F.when(F.col("kids") == 0, F.lit(1).cast("long")).otherwise(F.col("alone")).alias("leaves"),
                                 ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved")), "placed-nodes")
    totals = subtree_totals(placed)
    ended = (sequences.filter("last").select(*key, "conv_id")
             .unionByName(convs.filter(F.col("length") == 0).select(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "conv_id")))
    shared = (placed.drop("leaves", "saved").join(totals, key).join(_ends(ended), key, "left")
              .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
    return shared.unionByName(alone)


def prefix_trie(conversations: DataFrame, shared: Column | None = None, span: int = SPAN) -> DataFrame:
    """Trie of ``conversations`` (conv_id, turn, role, text); with ``shared``,
    a column of conv_id, of the conversations as :func:`rebuilt`.

    Nulls: a null role or text is an empty one, null turns come first, rows
    without a conv_id belong to no conversation.  Equal turn numbers stand in
    the order of a hash of role and text, repeated rows one after the other,
    each a turn.  An empty table gives an empty result; extra columns are
    ignored."""
    ready(conversations.sparkSession)
    rows = turns(conversations)
    sequences, convs = plain(rows) if shared is None else rebuilt(rows, shared, span)
    return trie(sequences, convs, span)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), fold(F.col("conv_id"), 6))
