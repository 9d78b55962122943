"""Benchmark passages in documents: rare n-gram seeds and Smith-Waterman.

Seeds are runs of ``SEED`` words of test items, compared without case or
punctuation.  A first pass over all documents counts in how many contexts each
seed occurs; a seed in at most ``RARE`` times the documents is rare.  A second
pass finds the seeds again: where a document holds a rare seed of an item, or
two different seeds near each other, or a common seed with enough of the
item's words around it, the passage is aligned with the item by words (match
+1, mismatch and gap -1, best local score); a lone common seed must bring more
than its own words, or the whole item.  The
score over the item's words is the similarity; edited and paraphrased copies
lose two for each replaced word and one for each dropped or added one.

Test items go to the tasks in blocks of at most ``BLOCK_BYTES`` of text (or
one item), each block against all documents, so that what is sent is bounded
whatever the benchmark's size.  Nothing is shuffled but the seeds' contexts, up
to the number in each task that makes a seed common.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, slices, table, texts

SEED = 3
RARE = 2e-4
SIMILARITY = 0.4
#: Words on either side of a seed that tell its occurrences apart.
CONTEXT = 3
BLOCK_BYTES = 4 << 20

_WORD = re.compile(r"\w+")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first, end) in words of the passage."""
    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        steps = np.arange(len(b) + 1)
        row, top = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
        for i, word in enumerate(a):
            new = np.maximum(0, row - 1)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == word, 1, -1))
            new = np.maximum.accumulate(new + steps) - steps  # gaps along the passage
            k = int(new.argmax())
            if new[k] > top[0]:
                top = int(new[k]), i + 1, k
            row = new
        return top

    score, i, end = best(item, passage)
    if not score:
        return 0, 0, 0
    back = best(item[:i][::-1], passage[:end][::-1])
    return score, end - back[2], end


class _Block:
    """Test items prepared for matching: words by number, seeds sorted."""

    def __init__(self, items: list[tuple[int, str]]):
        split = [(i, _WORD.findall(t.lower())) for i, t in items]
        self.items = [(i, ws) for i, ws in split if ws]
        self.number = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        self.words = [np.array([self.number[w] for w in ws], np.int64) for _, ws in self.items]
        self.counts = [Counter(ws.tolist()) for ws in self.words]
        self.at: dict[tuple, list] = defaultdict(list)
        for k, ws in enumerate(self.words):
            n = min(SEED, len(ws))  # an item shorter than a seed is its own seed
            for p in range(len(ws) - n + 1):
                self.at[tuple(ws[p:p + n].tolist())].append((k, p))
        self.seeds = sorted(self.at)
        self.index = {s: k for k, s in enumerate(self.seeds)}
        self.pairs = {s[:2] for s in self.seeds}
        self.short = {len(s) for s in self.seeds} - {SEED}
        self.rare = np.ones(len(self.seeds), bool)
        self.first = np.zeros(len(self.number) + 1, bool)
        for s in self.seeds:
            self.first[s[0]] = True

    def numbered(self, text: str) -> np.ndarray:
        return self.ids(_WORD.findall(text.lower()))

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], np.int64)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(place, seed) of all seeds in a numbered text."""
        found, get = [], self.index.get
        for n in [SEED, *self.short]:
            if len(ids) < n:
                continue
            all_known = self.first[ids[:len(ids) - n + 1]]
            for d in range(1, n):
                all_known = all_known & (ids[d:len(ids) - n + 1 + d] > 0)
            for p in np.flatnonzero(all_known).tolist():
                k = get(tuple(ids[p:p + n].tolist()))
                if k is not None:
                    found.append((p, k))
        return found

    def shared(self, k: int, passage: np.ndarray) -> int:
        """Words that an item and a passage share: no alignment scores more."""
        there = Counter(passage.tolist())
        return sum(min(n, there[w]) for w, n in self.counts[k].items())

    def matches(self, text: str) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, seeds, first word, end word) of each item that
        the text holds, by the best passage."""
        ids = self.numbered(text)
        near: dict[int, list] = defaultdict(list)
        for p, s in self.hits(ids):
            for k, q in self.at[self.seeds[s]]:
                near[k].append((p, q, s))
        out = []
        for k, hits in near.items():
            size = len(self.words[k])
            margin, best = size // 4 + SEED, None
            hits.sort()
            group: list = []
            for hit in [*hits, None]:
                if group and (hit is None or hit[0] - group[-1][0] > size + margin):
                    seeds = {s for _, _, s in group}
                    a = max(0, min(p - q for p, q, _ in group) - margin)
                    b = min(len(ids), max(p - q for p, q, _ in group) + size + margin)
                    # A lone common seed needs more than its own words.
                    least = 0 if len(seeds) > 1 or self.rare[next(iter(seeds))] else min(size, SEED + 1)
                    if not least or self.shared(k, ids[a:b]) >= max(least, SIMILARITY * size):
                        score, first, end = align(self.words[k], ids[a:b])
                        if score >= least and score / size >= SIMILARITY and (best is None or score > best[0]):
                            best = score, len(seeds), a + first, a + end
                    group = []
                if hit is not None:
                    group.append(hit)
            if best:
                out.append((self.items[k][0], best[0] / size, best[1], best[2], best[3]))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[_Block]:
    items = pick(benchmark, item_id="long", text="string").filter(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        block = _Block(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r)))
        if block.seeds:
            yield block


def _with_rarity(docs: DataFrame, block: _Block) -> _Block:
    """The block with its rare seeds marked from counts over all documents.
    A seed counts once for each distinct text before it, or after it if those
    are fewer, so copies of a passage don't make its seeds common."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    limit = max(1, int(RARE * docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bool], set] = defaultdict(set)
        for b in slices(batches, "text"):
            for text in b.column("text").to_pylist():
                words = _WORD.findall(text.lower())
                for p, s in sent.value.hits(sent.value.ids(words)):
                    n = len(sent.value.seeds[s])
                    for side, first, end in ((False, max(0, p - CONTEXT), p), (True, p + n, p + n + CONTEXT)):
                        if len(seen[s, side]) <= limit:  # else common by this task's texts alone
                            seen[s, side].add(crc32(" ".join(words[first:end]).encode("utf-8", "surrogatepass")))
        rows = [(s, side, c) for (s, side), contexts in seen.items() for c in sorted(contexts)[:limit + 1]]
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64()))], names=["seed", "after", "context"])

    rows = (docs.select("text").mapInArrow(run, "seed long, after boolean, context long").distinct()
            .groupBy("seed", "after").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
            .groupBy("seed").count().filter("count = 2").collect())
    block.rare = np.ones(len(block.seeds), bool)
    block.rare[[r.seed for r in rows]] = False
    return block


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and test item that it holds: doc_id, item_id,
    similarity, n_seeds, char_start, char_end (code points, end exclusive).

    Nulls: null and empty texts and items match nothing; null ids are
    returned as they are.  Repeated rows and items each give their rows; of a
    document's passages that match one item, the best and then the first
    counts.  Empty tables give an empty result; extra columns are ignored."""
    rows, spark = texts(docs), docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, n_seeds long, char_start long, char_end long"

    def finder(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                out = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    found = sent.value.matches(text)
                    if found:
                        # Lower-casing may change a text's length, so its words are found as matching found them.
                        at = [m.span() for m in _WORD.finditer(text)] if len(text.lower()) == len(text) else None
                        for item, similarity, seeds, first, end in found:
                            span = (at[first][0], at[end - 1][1]) if at and end <= len(at) else (None, None)
                            out.append((doc, item, similarity, seeds, *span))
                cols = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))],
                                                 names=["doc_id", "item_id", "similarity", "n_seeds", "char_start", "char_end"])
        return run

    out = None
    for block in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(_with_rarity(rows, block))
        part = rows.mapInArrow(finder(sent), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a test item, all columns
    kept; a row is decided where it lies."""
    rows = texts(docs)
    name = next(c for c in [*[c for c in docs.columns if c == "text"], *docs.columns] if c.lower() == "text")

    def keeper(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, name):
                clean = [not sent.value.matches(t or "") for t in b.column(b.schema.get_field_index(name)).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))
        return run

    kept = docs
    for block in _blocks(benchmark):
        kept = kept.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(_with_rarity(rows, block))), docs.schema)
    return kept


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
