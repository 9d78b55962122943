"""Near duplicates by SimHash fingerprints and a byte-position index.

A 64-bit fingerprint is eight (position, byte) entries.  Two fingerprints that
differ in at most ``max_bits`` (k) bits differ in at most k positions, so at
least ``8 - k`` positional bytes are shared: the guaranteed minimum.  A plain
index by single (position, byte) entries has 2,048 posting lists, each with
1/256 of all rows at best, and tallies the square of that.  Here the posting
lists are kept by (8 - k) positions at once - their intersections - so that
only pairs that reach the minimum meet at all.  A pair sharing more meets on
several lists; the tally of its shared bytes, taken from the two fingerprints,
names the first of them, and only there is the pair retained and verified by
its bit distance.

Rows of one fingerprint are one node, so exact and most near copies cost one
index row.  A list with more than ``BLOCK`` fingerprints is dealt out in
blocks, each pair of blocks compared by itself, and gives a spanning set of
links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, texts
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of one posting list that are compared in one go.
BLOCK = 2048
#: Lists up to this length give their pairs; longer ones a spanning set.
SHORT = 24


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """A-Z lower-cased, words between ASCII white space, shingles of
    ``shingle`` words with repeats (fewer words: the whole sequence); a bit is
    set if more than half of the shingles' XXH64 values have it."""
    words = text.encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, step, digest = len(words) - k + 1, 1 << 16, xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, n, step):
        j = min(n, i + step)
        hashes = np.array([digest(data[a:b], SEED) for a, b in zip(starts[i:j].tolist(), ends[i + k - 1:j + k - 1].tolist())], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([simhash(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    return texts(docs).mapInArrow(run, "doc_id long, fp long")


# -- the index ----------------------------------------------------------------


class _Lists:
    """The posting lists' position sets for a distance."""

    def __init__(self, max_bits: int):
        if not 0 <= max_bits <= 7:
            raise ValueError("the index needs a shared byte: 0 to 7 bits")
        self.max_bits = max_bits
        self.sets = list(combinations(range(8), 8 - max_bits))
        masks = [sum(0xFF << 8 * p for p in s) for s in self.sets]
        self.masks = [m - (1 << 64) if m >> 63 else m for m in masks]
        #: By the bits of shared positions: the first set that they hold.
        self.first = np.array([next((i for i, s in enumerate(self.sets) if all(shared >> p & 1 for p in s)), -1) for shared in range(256)], np.int16)

    def retained(self, x: np.ndarray, which) -> np.ndarray:
        """Of pairs by the differing bits ``x`` on list ``which``: those whose
        tally of shared bytes names this list, within the distance."""
        same = np.zeros(x.shape, np.uint8)
        for p in range(8):
            same |= ((x >> np.uint64(8 * p) & np.uint64(0xFF)) == 0).astype(np.uint8) << np.uint8(p)
        return (self.first[same] == which) & (np.bitwise_count(x) <= self.max_bits)


def _spanning(a: np.ndarray, b: np.ndarray | None, max_bits: int) -> tuple[list, list]:
    """Links that connect what the pairs within the distance connect; the
    pairs are those inside ``a``, or between ``a`` and ``b``."""
    from_, to = [], []
    nodes = a if b is None else np.concatenate([a, b])
    side = None if b is None else np.arange(len(nodes)) < len(a)
    left = np.ones(len(nodes), bool)
    for i in range(len(nodes)):
        if not left[i]:
            continue
        left[i], todo = False, [i]
        while todo:
            u = todo.pop()
            near = left & (np.bitwise_count(nodes ^ nodes[u]) <= max_bits)
            if side is not None:
                near &= side != side[u]
            for v in np.flatnonzero(near).tolist():
                left[v] = False
                todo.append(v)
                from_.append(nodes[u])
                to.append(nodes[v])
    return from_, to


_LINKS = "kind int, which int, key long, a long, b long"


def _list_links(max_bits: int) -> callable:
    """Rows (which, key, fp) sorted by list -> links (kind 0), and the rows of
    the lists with more than ``BLOCK`` fingerprints as they are (kind 1).
    At most one batch and one list of ``BLOCK`` rows are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists(max_bits)

        def out(kind: int, which, key, a, b) -> pa.RecordBatch:
            n = len(a)
            full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n))
            return pa.RecordBatch.from_arrays([full(kind, np.int32), full(which, np.int32), full(key, np.int64), pa.array(np.asarray(a, np.uint64).view(np.int64)),
                                               pa.array(np.asarray(b, np.uint64).view(np.int64))], names=["kind", "which", "key", "a", "b"])

        def closed(which: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole lists, each of at most BLOCK rows."""
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            size = np.diff(np.append(new, len(key)))
            length = np.repeat(size, size)
            for d in range(1, min(SHORT, size.max(initial=0))):
                i = np.flatnonzero((key[d:] == key[:-d]) & (length[d:] <= SHORT))
                if len(i):
                    keep = i[lists.retained(fp[i] ^ fp[i + d], which[i])]
                    if len(keep):
                        yield out(0, which[keep], key[keep], fp[keep], fp[keep + d])
            for s, n in zip(new[size > SHORT].tolist(), size[size > SHORT].tolist()):
                a, b = _spanning(fp[s:s + n], None, max_bits)
                if a:
                    yield out(0, which[s], key[s], a, b)

        held, big = None, None  # rows of the list that may go on; the key of a list known to be large
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("which", "key", "fp")]
            cols[2] = cols[2].view(np.uint64)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            which, key, fp = cols
            if big is not None:
                n = int(np.searchsorted(key != big, True)) if (key != big).any() else len(key)
                if n:
                    yield out(1, which[:n], key[:n], fp[:n], fp[:n])
                which, key, fp = which[n:], key[n:], fp[n:]
                if not len(key):
                    held = None
                    continue
                big = None
            if not len(key):
                continue
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(new, len(key)))
            last = int(new[-1])
            large = np.repeat(size, size) > BLOCK
            done = np.arange(len(key)) < last
            some = done & ~large
            yield from closed(which[some], key[some], fp[some])
            if (done & large).any():
                yield out(1, *(x[done & large] for x in (which, key, fp, fp)))
            if large[-1]:
                yield out(1, which[last:], key[last:], fp[last:], fp[last:])
                held, big = None, key[last]
            else:
                held = [x[last:] for x in (which, key, fp)]
        if held is not None:
            yield from closed(*held)
    return run


def _large_links(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links of the large lists: each list's fingerprints in blocks of about
    ``BLOCK``, a group for each pair of blocks."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = (rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("a").alias("fp")))

    def compared(key, pdf):
        fp, block = pdf["fp"].to_numpy().view(np.uint64), pdf["block"].to_numpy()
        one = _spanning(fp, None, max_bits) if key[1] == key[2] else _spanning(fp[block == key[1]], fp[block == key[2]], max_bits)
        return pd.DataFrame({"a": np.array(one[0], np.uint64).view(np.int64), "b": np.array(one[1], np.uint64).view(np.int64)})

    return dealt.groupBy("key", "i", "j").applyInPandas(compared, "a long, b long")


def fingerprint_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that connect all
    that lie within the distance."""
    lists = _Lists(max_bits)
    entry = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("which"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))).alias("key"))
                                for i, m in enumerate(lists.masks)]))
    index = nodes.select("fp", entry.alias("e")).select("e.which", "e.key", "fp")
    found = materialize(index.repartition("key").sortWithinPartitions("key", "which").mapInArrow(_list_links(max_bits), _LINKS), "simhash-lists")
    large = _large_links(found.filter("kind = 1").select("key", "a"), max_bits)
    return found.filter("kind = 0").select("a", "b").unionByName(large)


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row.

    Nulls: a null text counts as empty; empty texts have fingerprint 0 and are
    linked like any other; a row with a null doc_id takes part and gets its
    component's smallest id, null if there is none.  Repeated rows are kept.
    An empty table gives an empty result; extra columns are ignored."""
    base = materialize(fingerprints(docs, shingle), "simhash-base")
    nodes = materialize(base.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    comp = materialize(components(fingerprint_links(nodes.select("fp"), max_bits)), "simhash-components")
    labelled = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = materialize(labelled.join(ids, "component").select("fp", "component_id"), "simhash-ids")
    return base.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id,
    all columns kept.  Rows that repeat an id stay or go together; rows
    without an id stay."""
    found = simhash_dedup(docs, shingle, max_bits)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(materialize(gone, "simhash-gone"), "doc_id", "left_anti").select(*docs.columns)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
