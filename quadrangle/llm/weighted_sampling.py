"""Document fingerprints by consistent weighted sampling.

A text is a bag of word shingles, each weighted by its occurrences.  Sample
number i draws for every term r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1)
from the term's hash, sets for a weight w

    t = floor(ln w / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r,

and keeps the (term, t) of the least a.  Two bags keep the same one with
probability sum(min) / sum(max) over their weights, the generalised Jaccard
similarity, so the share of equal samples of two fingerprints estimates it
(standard error under 0.045 with ``SAMPLES`` = 128).  ``a`` is a function
of term and t alone, so a byte made from its bits stands for the sample; what
different samples share by chance, 1 in 255, is taken off.

r and b are drawn together: with two exponential numbers e1, e2 their sum is
Gamma(2, 1) and e1 / (e1 + e2) uniform and independent of it.  Then a = c u
exp(-r t) where u = exp(-e2) is uniform, and a term of weight 1, for which
t = 0, needs c and u alone.

Rows are dealt by ranges of doc_id, the only shuffle of texts.  A task passes
through its rows in order with two of them in hand; the two ends of each
range are joined by range number afterwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, ready, slices, table

WORDS = 5
SAMPLES = 128
#: Characters of a text that are split at once; words stay whole.
BLOCK = 1 << 20
#: Terms that are drawn for at once.
DRAWN = 256
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 300_000


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal steps (Newton)."""
    u = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * u) + u * u
    for _ in range(60):
        x = np.maximum(x - ((1 - (1 + x) * np.exp(-x)) - u) / np.maximum(x * np.exp(-x), 1e-12), 1e-9)
    return x


_C_BITS = 12
_C = _gamma_quantiles(1 << _C_BITS).astype(np.float32)
_rng = np.random.default_rng(20_011)
_DRAWS = _rng.integers(0, 1 << 63, (2, SAMPLES), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 1 << 63, WORDS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_SPACE = re.compile(r"\s")


class _Words(dict):
    """Numbers of the words met, by which ``hashes`` holds their hashes."""

    def __init__(self, most: int):
        self.hashes = np.zeros(most, np.uint64)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.hashes[i] = xxhash.xxh3_64_intdigest(word.encode())
        return i


_known = _Words(2 * REMEMBERED)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word (run without white space), the text split block by
    block at white space."""
    global _known
    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        for i in range(0, len(words), REMEMBERED):
            if len(_known) > REMEMBERED:
                _known = _Words(2 * REMEMBERED)
            some = words[i:i + REMEMBERED]
            parts.append(_known.hashes[np.fromiter(map(_known.__getitem__, some), np.int64, len(some))])
        at = end
    return _mixed(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _edited_hashes(text: str, hashes: np.ndarray, donor: str) -> np.ndarray:
    """Word hashes of the edited text; those of words that end before its
    changed part are taken from the text's own."""
    cut = len(text) - len(text) // 4
    first = max(0, cut - 1024)
    spaces = [m.end() for m in _SPACE.finditer(text, first, cut)]
    if not spaces and first:
        return word_hashes(edited(text, donor))
    at = spaces[-1] if spaces else 0
    return np.concatenate([hashes[:len(hashes) - _count(text, at)], word_hashes(text[at:cut] + donor[:len(text) // 4])])


def _count(text: str, at: int) -> int:
    """Words of ``text`` from ``at`` on, counted block by block."""
    n = 0
    while at < len(text):
        cut = _SPACE.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        n, at = n + len(text[at:end].split()), end
    return n


def weighted_terms(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) of the distinct shingles of ``WORDS`` words, from the
    word hashes of a text; a text of fewer words has one term, all of them;
    one without words none."""
    if not len(h):
        return h, np.empty(0, np.int64)
    n = min(len(h), WORDS)
    x = h[:len(h) - n + 1] * _PLACES[0]
    x += np.uint64(n)
    for j in range(1, n):
        x += h[j:len(h) - n + 1 + j] * _PLACES[j]
    x = _mixed(x)
    x.sort()
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(first, append=len(x))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers over 0 and under 1 from the upper 23 of 32 bits."""
    bits >>= np.uint32(9)
    bits |= np.uint32(0x3F800000)
    u = bits.view(np.float32)  # 1 to 2
    u -= np.float32(1 - 2.0 ** -24)
    return u


def _least(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The least a of each sample number over the terms."""
    out = np.full(SAMPLES, np.inf, np.float32)
    for i in range(0, len(hashes), DRAWN):
        x = hashes[i:i + DRAWN, None] ^ _DRAWS[0]
        x *= _DRAWS[1]
        u = _uniform((x >> np.uint64(64 - _C_BITS - 32)).astype(np.uint32))
        a = np.take(_C, (x >> np.uint64(64 - _C_BITS)).view(np.int64), mode="clip")
        a *= u
        w = weights[i:i + DRAWN]
        many = np.flatnonzero(w > 1)
        if len(many):
            e1 = -np.log(_uniform((_mixed(x[many]) >> np.uint64(32)).astype(np.uint32)))
            r = e1 - np.log(u[many])
            a[many] *= np.exp(-r * np.floor((np.log(w[many]).astype(np.float32)[:, None] + e1) / r))
        np.minimum(out, a.min(axis=0), out=out)
    return out


def _signature(least: np.ndarray) -> np.ndarray:
    """A byte a sample, never 0; zeros for a text without terms."""
    bits = least.view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(np.isinf(least), 0, 1 + (bits >> np.uint64(40)) % np.uint64(255)).astype(np.uint8)


def fingerprint(text: str) -> np.ndarray:
    """The ``SAMPLES`` samples of one text."""
    return _signature(_least(*weighted_terms(word_hashes(text))))


def _pair(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two bags; terms that both hold with the same weight
    are drawn for once."""
    (ha, wa), (hb, wb) = a, b
    at = np.minimum(np.searchsorted(ha, hb), max(len(ha) - 1, 0))
    both = (ha[at] == hb) & (wa[at] == wb) if len(ha) else np.zeros(len(hb), bool)
    rest = np.ones(len(ha), bool)
    rest[at[both]] = False
    shared = _least(hb[both], wb[both])
    return (_signature(np.minimum(shared, _least(ha[rest], wa[rest]))), _signature(np.minimum(shared, _least(hb[~both], wb[~both]))))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, less what different ones share by chance, as
    a byte stands for each."""
    return max(0.0, (float((a == b).mean()) - 1 / 255) / (1 - 1 / 255))


# -- a text, its edited form and the next text ---------------------------------


def edited(text: str, donor: str) -> str:
    """``text`` with its last quarter replaced by as much of ``donor``."""
    q = len(text) // 4
    return text[:len(text) - q] + donor[:q]


_ROWS = ("part int, place int, doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
         "near_edited double, near_next double, text string")
#: What a row of the scan is: finished, the first of its range (text and
#: fingerprint), or the last of it (text).
DONE, FIRST, LAST = 0, 1, 2


def _compared(text: str, hashes: np.ndarray, donor: str) -> tuple:
    """(n_chars, digest of the edited text, both fingerprints, likeness)."""
    mine, other = _pair(weighted_terms(hashes), weighted_terms(_edited_hashes(text, hashes, donor)))
    return len(text), hashlib.sha256(edited(text, donor).encode()).digest(), mine, other, likeness(mine, other)


def _finished(part: int, doc_id, got: tuple, next_mark: np.ndarray) -> tuple:
    n, digest, mine, other, near = got
    return part, DONE, doc_id, n, digest, mine.tobytes(), other.tobytes(), near, likeness(mine, next_mark), None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_ARROW = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()),
                    ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                    ("text", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows = TaskContext.get().partitionId(), []
    waits = held = None  # compared, but for the next one's fingerprint; not yet compared
    for b in slices(batches, "text", 2 << 20):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            hashes = word_hashes(text)
            if held is None:
                rows.append((part, FIRST, doc_id, None, None, _signature(_least(*weighted_terms(hashes))).tobytes(), None, None, None, text))
            else:
                got = _compared(held[1], held[2], text)
                if waits is not None:
                    rows.append(_finished(part, *waits, got[2]))
                waits = held[0], got
            held = doc_id, text, hashes
        if len(rows) >= 256:
            yield _batch(rows, _ARROW)
            rows = []
    if held is not None:
        if waits is not None:
            rows.append(_finished(part, *waits, _signature(_least(*weighted_terms(held[2])))))
        rows.append((part, LAST, held[0], None, None, None, None, None, None, held[1]))
        yield _batch(rows, _ARROW)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(slices(batches, "text", 4 << 20), "next_text", 4 << 20):
        for r in b.to_pylist():
            got = _compared(r["text"], word_hashes(r["text"]), r["next_text"])
            yield _batch([_finished(r["part"], r["doc_id"], got, np.frombuffer(r["next_mark"], np.uint8))], _ARROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited form, whose last quarter
    is replaced by the beginning of the next text (by ascending doc_id; after
    the last the first), and the likeness of the text's fingerprint to the
    edited text's and to the next text's.

    Nulls: a null text is an empty one; null ids come first.  Empty texts and
    those of white space alone have a fingerprint of zeros, like each other
    and nothing else.  Repeated ids stand in the order of their texts'
    hashes, repeated rows one after the other.  A single row is its own next
    one.  An empty table gives an empty result; extra columns are ignored."""
    spark = docs.sparkSession
    ready(spark)
    rows = pick(docs, doc_id="long", text="string").fillna({"text": ""})
    # The last key only deals out repeated rows, which are alike.
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("_r", F.rand(11))
    scanned = materialize(rows.repartitionByRange("doc_id", "_h", "_r").sortWithinPartitions("doc_id", "_h", "_r")
                          .select("doc_id", "text").mapInArrow(_scan, _ROWS), "fingerprints")
    # One number for each range that has rows.
    parts = sorted(r.part for r in scanned.filter(F.col("place") == FIRST).select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    firsts = scanned.filter(F.col("place") == FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"),
                                                            F.col("fingerprint").alias("next_mark"))
    lasts = (scanned.filter(F.col("place") == LAST).select("part", "doc_id", "text").join(follows, "part").join(firsts, "next_part")
             .select("part", "doc_id", "text", "next_text", "next_mark").mapInArrow(_ends, _ROWS))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return scanned.filter(F.col("place") == DONE).unionByName(lasts).select(
        "doc_id", "n_chars", hexed("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
