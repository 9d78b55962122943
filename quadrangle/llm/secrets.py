"""Secrets in texts: fixed patterns and a battery of randomness tests.

Beside three patterns (assignments to a password-like name, access keys, long
hex strings) every run of at least ``SHORTEST`` characters that keys are
written in is tested.  Its encoding is the smallest alphabet that holds all
its characters.  Three tests take its symbols: chi-squared for uniform use of
the alphabet, runs above and below the alphabet's middle, and serial
correlation of neighbours.

Each test gives the probability that ordinary text would look as random as
the run does.  What ordinary text does is measured over all documents, as
counts of neighbouring characters.  The three are combined by Fisher's method.
A run must also pass as uniform itself (``UNIFORM``).  Ordinary text that is
glued to a key hides it, so the pieces of a run are tested, too; the best one
is the span, and its probability counts all tests of the run.  False discoveries are
controlled per class of length (Benjamini and Hochberg at ``RATE``), so many
short runs don't hide, or raise, a few long ones.  Counts of probabilities in
bins, a fixed number for each class, are all that is gathered for it.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, texts

SHORTEST = 20
RATE = 0.01
UNIFORM = 1e-4
#: Parts of a run between separators that are tested together; how many times
#: less probable a piece is than the whole run if it stands for it.
JOINED, WHOLE = 4, 100.0
#: Letters of ordinary text come in words, not one by one: its statistics
#: vary that many times as much as those of single letters.
CLUSTER = 4.0
#: Lower ends of the classes of length.
CLASSES = (20, 32, 48, 96)
#: Characters of a run whose windows are tested together.
STRETCH = 1 << 20
#: Bins of -log10 p, so many for each power of ten, up to the last.
BINS, LAST_BIN = 20, 6000

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)

_PART, _WORD = re.compile(r"[^/_-]+"), re.compile(r"[A-Z]?[a-z]{3,}")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Smallest first; a run's encoding is the first that holds its characters.
ALPHABETS = [sorted(a) for a in (_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _LOWER + "234567", _LOWER + _DIGITS, _UPPER + _DIGITS,
                                 _LOWER + _UPPER, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/", _LOWER + _UPPER + _DIGITS + "-_",
                                 _LOWER + _UPPER + _DIGITS + "+/-_")]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by the patterns.  An assignment with a short value
    is dropped, but what it covers isn't searched again."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _normals(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.fromiter(map(math.erfc, (-z / math.sqrt(2)).tolist()), float, len(z))


def _chi2_tail(x: float, df: int) -> float:
    """P(chi-squared >= x), by Wilson and Hilferty's cube root."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * df)
    return _normal(-((x / df) ** (1 / 3) - 1 + v) / math.sqrt(v))


def _largest(holds: callable) -> float:
    """The largest number, to a part in 10^12, for which ``holds`` does; it
    holds from 0 up to some number."""
    lo, hi = 0.0, 1.0
    while holds(hi):
        lo, hi = hi, 2 * hi
    while hi - lo > 1e-12 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if holds(mid) else (lo, mid)
    return lo


@functools.cache
def _chi2_most(df: int) -> float:
    """Chi-squared up to which a run passes as uniform."""
    return _largest(lambda x: _chi2_tail(x, df) >= UNIFORM)


_MOST_DEVIATION = _largest(lambda x: 2 * _normal(-x) >= UNIFORM)


@dataclass
class TextModel:
    """What ordinary text does in each alphabet: the squared distance of its
    use from uniform, how often neighbours lie on both sides of the middle
    and the mean and variance of their product."""

    figures: list[tuple[float, float, float, float]]

    @classmethod
    def of(cls, pairs: np.ndarray) -> TextModel:
        """From counts of neighbouring ASCII characters."""
        out = []
        for alphabet in ALPHABETS:
            at = [ord(c) for c in alphabet]
            k, p = len(at), pairs[np.ix_(at, at)].astype(float) + 1e-3
            use = (p.sum(axis=0) + p.sum(axis=1)) / (2 * p.sum())
            p /= p.sum()
            x = _values(k)
            product = np.outer(x, x)
            mean = float((p * product).sum())
            out.append((float(k * ((use - 1 / k) ** 2).sum()), float(np.clip((p * (np.sign(x)[:, None] != np.sign(x))).sum(), 0.01, 0.99)),
                        mean, float(max(1e-3, (p * product ** 2).sum() - mean ** 2))))
        return cls(out)

    def probability(self, run: str) -> float | None:
        """That ordinary text looks as random as ``run`` does; None if the run
        itself isn't uniform enough for a random one."""
        body = run.rstrip("=")
        chars = set(body)
        which = next((i for i, a in enumerate(ALPHABETS) if chars <= set(a)), None)
        if which is None or len(body) < 2:
            return None
        alphabet, (distance, cross, mean, var) = ALPHABETS[which], self.figures[which]
        n, k = len(body), len(alphabet)
        place = {c: i for i, c in enumerate(alphabet)}
        s = np.array([place[c] for c in body])
        counts = np.bincount(s, minlength=k)
        chi2 = float(((counts - n / k) ** 2).sum() * k / n)
        x = _values(k)[s]
        # Uniform?  The alphabet, the runs and the neighbours of a random run.
        runs, product = float((np.sign(x[1:]) != np.sign(x[:-1])).sum()), float((x[1:] * x[:-1]).mean())
        even = 2 * (k // 2) * (k - k // 2) / k ** 2
        deviation = max(abs(runs - (n - 1) * even) / math.sqrt((n - 1) * even * (1 - even)), abs(product) * math.sqrt(n - 1))
        if _chi2_tail(chi2, k - 1) < UNIFORM or 2 * _normal(-deviation) < UNIFORM:
            return None
        ps = [_normal((chi2 - (k - 1) - n * distance) / math.sqrt(CLUSTER * (2 * (k - 1) + 4 * n * distance)))]
        z = (runs - (n - 1) * cross) / math.sqrt(CLUSTER * (n - 1) * cross * (1 - cross))
        ps.append(_normal(z if even < cross else -z))
        z = (product - mean) / math.sqrt(CLUSTER * var / (n - 1))
        ps.append(_normal(z if mean > 0 else -z))
        half = -sum(math.log(max(p, 1e-300)) for p in ps)
        return math.exp(-half) * (1 + half + half * half / 2)


    def probabilities(self, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """:meth:`probability` of each of many windows of ``text``, NaN for
        None and for windows of four characters or fewer, from running sums:
        the cost goes by the text and the number of windows, not by what they
        hold together."""
        codes, n = np.frombuffer(text.encode(), np.uint8), (ends - starts).astype(float)
        distinct, squares = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for c in np.unique(codes):
            sums = np.concatenate([[0], np.cumsum(codes == c)])
            held = sums[ends] - sums[starts]
            distinct += held > 0
            squares += held * held
        out, left = np.full(len(starts), np.nan), distinct > 4
        for alphabet, (distance, cross, mean, var) in zip(ALPHABETS, self.figures):
            if not left.any():
                break
            sums, k = _Running.over(codes, alphabet), len(alphabet)
            here = np.flatnonzero(left)
            here = here[sums.inside[ends[here]] - sums.inside[starts[here]] == ends[here] - starts[here]]
            left[here] = False
            a, z, m = starts[here], ends[here], n[here]
            chi2 = squares[here] * k / m - m
            runs = (sums.changes[z - 1] - sums.changes[a]).astype(float)
            product = (sums.products[z - 1] - sums.products[a]) * 3 / (k * k - 1) / (m - 1)
            even = 2 * (k // 2) * (k - k // 2) / k ** 2
            deviation = np.maximum(np.abs(runs - (m - 1) * even) / np.sqrt((m - 1) * even * (1 - even)), np.abs(product) * np.sqrt(m - 1))
            random = np.flatnonzero((chi2 <= _chi2_most(k - 1)) & (deviation <= _MOST_DEVIATION))
            here, m, chi2, runs, product = here[random], m[random], chi2[random], runs[random], product[random]
            ps = [_normals((chi2 - (k - 1) - m * distance) / np.sqrt(CLUSTER * (2 * (k - 1) + 4 * m * distance)))]
            z = (runs - (m - 1) * cross) / np.sqrt(CLUSTER * (m - 1) * cross * (1 - cross))
            ps.append(_normals(z if even < cross else -z))
            z = (product - mean) / np.sqrt(CLUSTER * var / (m - 1))
            ps.append(_normals(z if mean > 0 else -z))
            half = -sum(np.log(np.maximum(p, 1e-300)) for p in ps)
            out[here] = np.exp(-half) * (1 + half + half * half / 2)
        return out


@dataclass
class _Running:
    """Running sums over a text in one alphabet: characters in it, changes of
    side and products of neighbours (as twice the distance from the middle,
    so whole numbers)."""

    inside: np.ndarray
    changes: np.ndarray
    products: np.ndarray

    @classmethod
    def over(cls, codes: np.ndarray, alphabet: list[str]) -> _Running:
        k, place = len(alphabet), np.full(128, -1, np.int64)
        place[[ord(c) for c in alphabet]] = np.arange(k)
        at = place[codes]
        x = 2 * at - (k - 1)
        zero = np.zeros(1, np.int64)
        return cls(np.concatenate([zero, np.cumsum(at >= 0)]), np.concatenate([zero, np.cumsum((x[1:] > 0) != (x[:-1] > 0))]),
                   np.concatenate([zero, np.cumsum(x[1:] * x[:-1])]))


def _windows(start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of overlapping windows of several lengths, those of one
    stretch of text together; their number grows with the run."""
    sizes = [SHORTEST]
    while sizes[-1] * 7 // 5 < end - start:
        sizes.append(sizes[-1] * 7 // 5)
    sizes = np.array([size for size in sizes if size < end - start], np.int64)
    for some in [sizes[sizes <= STRETCH // 4], *sizes[sizes > STRETCH // 4, None]]:
        for at in range(start, end, STRETCH) if len(some) else ():
            starts = []
            for size in some.tolist():
                step = max(1, size // 4)
                first = start + -(-(at - start) // step) * step
                starts.append(np.arange(first, min(at + STRETCH, end - size), step))
                if at <= end - size < at + STRETCH:
                    starts[-1] = np.append(starts[-1], end - size)
            every = np.concatenate(starts)
            if len(every):
                yield every, every + np.repeat(some, [len(x) for x in starts])


def pieces(model: TextModel, run: str) -> list[tuple[int, int, float | None]]:
    """(start, end, p) of the run's pieces that look random, the best ones that
    don't overlap, or of the whole run.  Pieces are the run, up to ``JOINED``
    neighbours of its parts between separators, none of them a word, and
    windows where those aren't uniform.  Each p is that of the best of all
    tests made on the run."""
    found, tests, n = [], 0, len(run)

    def tried(start: int, end: int) -> bool:
        nonlocal tests
        tests += 1
        p = model.probability(run[start:end]) if len(set(run[start:end])) > 4 else None
        if p is not None:
            # The whole run gives way to pieces that are far better, or if words are in it.
            weight = p if (start, end) != (0, n) else 1 + p if worded else p / WHOLE
            found.append((weight, start - end, start, end, p))
        return p is not None

    parts = [m.span() for m in _PART.finditer(run)]
    words = [len(parts) > 1 and bool(_WORD.fullmatch(run, *p)) for p in parts]
    worded = any(words)
    whole = tried(0, n)
    for i in range(len(parts)):
        for j in range(i, min(len(parts), i + JOINED)):
            if words[j] and (i < j or parts[j][1] - parts[j][0] < SHORTEST):
                break
            start, end = parts[i][0], parts[j][1]
            if end - start >= SHORTEST and not ((start, end) == (0, n) and whole):
                if ((start, end) == (0, n) or not tried(start, end)) and i == j:
                    for first, last in _windows(start, end):
                        lo, hi = int(first.min()), int(last.max())
                        tests += len(first)
                        ps = model.probabilities(run[lo:hi], first - lo, last - lo)
                        for w in np.flatnonzero(~np.isnan(ps)).tolist():
                            a, z, p = int(first[w]), int(last[w]), float(ps[w])
                            found.append((p, a - z, a, z, p))
            if words[j]:
                break
    out: list[tuple[int, int, float | None]] = []
    taken = bytearray(n)
    for _, _, start, end, p in sorted(found):
        if taken.find(1, start, end) >= 0 or out and p * tests >= 1:
            continue
        taken[start:end] = b"\1" * (end - start)
        out.append((start, end, min(1.0, p * tests)))
    return sorted(out) or [(0, n, None)]


def _outside(start: int, end: int, spans: list[tuple[int, str, int]]) -> Iterator[tuple[int, int]]:
    """What the spans, sorted by start, leave of a run."""
    for s, _, e in spans:
        if s < end and start < e:
            if s - start >= SHORTEST:
                yield start, s
            start = max(start, e)
    if end - start >= SHORTEST:
        yield start, end


def _values(k: int) -> np.ndarray:
    """The symbols 0 .. k - 1 as numbers of mean 0 and variance 1."""
    x = np.arange(k) - (k - 1) / 2
    return x / x.std()


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(128 * 128, np.int64)
    for b in slices(batches, "text"):
        data = np.frombuffer("\n".join(b.column("text").to_pylist()).encode(), np.uint8)
        both = (data[1:] < 128) & (data[:-1] < 128)
        total += np.bincount(data[:-1][both].astype(np.int64) * 128 + data[1:][both], minlength=128 * 128)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["pair", "n"])


def _length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def _bin(p: float) -> int:
    return min(LAST_BIN, int(-math.log10(max(p, 1e-300)) * BINS))


_SCAN = "doc_id long, base array<struct<start:long,kind:string,end:long>>, runs array<struct<start:long,end:long,class:int,bin:int>>"


def _scan(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
        tried = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())])
        for b in slices(batches, "text"):
            base, runs = [], []
            for text in b.column("text").to_pylist():
                found, tests = base_spans(text), []
                for m in _RUN.finditer(text):
                    for first, last in _outside(m.start(), m.end(), found):
                        for start, end, p in pieces(model.value, text[first:last]):
                            # A run that isn't uniform is a test that found nothing.
                            tests.append({"start": first + start, "end": first + end, "class": _length_class(end - start), "bin": 0 if p is None else _bin(p)})
                base.append([dict(zip(("start", "kind", "end"), s)) for s in found])
                runs.append(tests)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(runs, pa.list_(tried))], names=["doc_id", "base", "runs"])
    return run


def least_bins(counts: dict[tuple[int, int], int]) -> dict[int, int]:
    """Benjamini and Hochberg's threshold of each class from counts by (class,
    bin): the lowest bin whose runs are all discoveries.  A bin's runs count
    with the bin's largest probability."""
    out = {}
    for cls in {c for c, _ in counts}:
        of = {b: n for (c, b), n in counts.items() if c == cls}
        m, seen = sum(of.values()), 0
        for b in sorted(of, reverse=True):
            seen += of[b]
            if b > 0 and 10 ** (-b / BINS) <= RATE * seen / m:
                out[cls] = b
    return out


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of each
    row; spans are kind:start:end in code points, end exclusive.

    Nulls: a null text counts as empty and has no spans (base_sha256 is that
    of the empty string); null ids and repeated rows are kept.  An empty table
    gives an empty result; extra columns are ignored."""
    rows, spark = texts(docs), docs.sparkSession
    pairs = np.zeros(128 * 128)
    for r in rows.select("text").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    model = spark.sparkContext.broadcast(TextModel.of(pairs.reshape(128, 128)))
    scanned = materialize(rows.mapInArrow(_scan(model), _SCAN), "secret-scan")
    tests = scanned.select(F.explode("runs").alias("r")).groupBy("r.class", "r.bin").count().collect()
    least = least_bins({(r["class"], r["bin"]): r["count"] for r in tests})
    cut = F.array(*[F.lit(least.get(c, LAST_BIN + 1)) for c in range(len(CLASSES))])
    hits = F.filter("runs", lambda r: r["bin"] >= F.element_at(cut, r["class"] + 1))
    random = F.transform(hits, lambda r: F.struct(r["start"].alias("start"), F.lit("random").alias("kind"), r["end"].alias("end")))
    # No two kinds can start at one place, so the order of kinds never decides.
    both = F.array_sort(F.concat("base", "random"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return (scanned.withColumn("random", random).withColumn("both", both)
            .select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                    F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("both")).alias("spans"),
                    F.size("random").cast("long").alias("n_random")))


def op2_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def sha256_of(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
