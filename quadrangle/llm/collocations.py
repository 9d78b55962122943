"""Phrase collocations from count streams in prefix and suffix order.

Counting.  For each length up to ``LONGEST`` - 1, one pass over the texts
makes a filter of fixed size: a bit for each of ``FILTER_BITS`` buckets of
phrase hashes that together occur ``LEAST`` times.  A phrase takes part only
where both phrases of one word less are in the filter before.  Tasks send
their counts by bucket, four bytes each, and never the phrases.  A last pass
counts the phrases themselves, whose buckets are set; a false hit of a filter
costs a row there and is dropped by its exact count, and on tables so large
that most buckets are full the filters only spare less.

Estimation layout.  The streams of all lengths, root included (the empty
phrase, whose count is the number of words), are dealt by ranges of their
sort order and merged in lockstep: in prefix order every phrase comes after
its own first parts, which are at hand as a stack of at most ``LONGEST``
entries, and before its extensions to the right; in suffix order (words
reversed) the same holds for its last parts and extensions to the left.  A
phrase whose extensions go on in later ranges is also sent there, so a word
that begins very many phrases is divided like any others.  No table of counts
is held or looked up.

Every phrase inside a longer one occurs at least as often, so a longer phrase
that holds a candidate as often as it occurs is met among its extensions by
one word: an extension by several has a count at most that of one by one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick, ready, slices, table

LEAST = 100
LONGEST = 5
TOP = 2_000
FILTER_BITS = 1 << 27
#: Buckets whose counts are added up together.
BLOCK_BITS = 19
#: Phrase hashes after which a task combines and sends them.
POSITIONS = 4_000_000
#: Distinct phrases, and bytes in them, after which a task sends their counts,
#: in a row for each of so many groups of phrases.
PHRASES, PHRASE_BYTES, GROUPS = 400_000, 64 << 20, 4096
#: Rows looked at to find the ends of the ranges.
SAMPLE = 20_000

# -- words --------------------------------------------------------------------

#: Between pieces of a text; not a byte of UTF-8.
_END = b"\xff"
_TABLE = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = _END[0]
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
_TABLE[9] = 32
_TABLE = bytes(_TABLE)
#: Factors of a word's bytes by their place, two for each.
_FACTORS = np.random.default_rng(20_013).integers(0, 1 << 63, (2, 4096), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


class _Words:
    """The words of some texts: where they begin and end in ``data``, their
    text and piece, and a hash (two, if ``twice``) by language."""

    def __init__(self, texts: list[str], langs: list[str], twice: bool = False):
        parts = [t.encode() for t in texts]
        self.data = (_END.join(parts) + _END).translate(_TABLE)
        b = np.frombuffer(self.data, np.uint8)
        inside = (b != 32) & (b != _END[0])
        edges = np.flatnonzero(np.diff(inside, prepend=False))  # the data end with _END
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(b == _END[0]), self.start)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.text = np.searchsorted(np.cumsum(sizes + 1), self.start, side="right")
        seeds = {lang: _seed(lang) for lang in set(langs)}
        seed = np.fromiter((seeds[lang] for lang in langs), np.uint64, len(langs))[self.text]
        size = self.end - self.start
        at = np.flatnonzero(inside)
        place = at - np.repeat(self.start, size)
        first = np.cumsum(size) - size
        self.marks = []
        for factors in _FACTORS[:1 + twice]:
            factor = factors[place & 4095]
            if len(place) and place.max() > 4095:
                factor = factor + (place >> 12).astype(np.uint64) * (_TIMES << np.uint64(1))
            factor *= b[at]
            sums = np.add.reduceat(factor, first) if len(first) else np.empty(0, np.uint64)
            self.marks.append(_mixed(sums + size.astype(np.uint64) * _TIMES ^ seed))


def _longer(marks: np.ndarray, word_marks: np.ndarray) -> np.ndarray:
    """Marks of phrases with one more word at their end."""
    return _mixed(marks * _TIMES + word_marks)


def _in_filter(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = marks & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _phrases(words: _Words, filters: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(n, first words, marks) of the phrases of n words whose parts of one
    word less are in the filters, n from 1 to ``longest``."""
    at, marks = np.arange(len(words.start)), words.marks
    for n in range(1, longest + 1):
        yield n, at, marks
        if n < longest:
            keep = np.flatnonzero(_in_filter(filters[n - 1], marks[0]))
            at, marks = at[keep], [m[keep] for m in marks]
            follows = at[1:] == at[:-1] + 1
            if n == 1:
                follows &= words.piece[at[1:]] == words.piece[at[:-1]]
            follows = np.flatnonzero(follows)
            at = at[follows]
            marks = [_longer(m[follows], w[at + n]) for m, w in zip(marks, words.marks)]


# -- filters --------------------------------------------------------------------

_MOST = (1 << 32 - BLOCK_BITS) - 1  # a count takes the rest of 32 bits


def _bucket_counts(n: int, sent: list, bits: int) -> callable:
    """Counts of the phrases of n words by bucket: a row for each block of
    buckets, with bucket and count in 32 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [np.frombuffer(s.value, np.uint8) for s in sent]
        held, size = [], 0

        def send() -> pa.RecordBatch:
            bucket, count = np.unique(np.concatenate(held), return_counts=True)
            packed = (bucket & (1 << BLOCK_BITS) - 1) << 32 - BLOCK_BITS | np.minimum(count, _MOST)
            block = bucket >> BLOCK_BITS
            first = np.flatnonzero(np.diff(block, prepend=-1))
            data = [p.astype("<u4").tobytes() for p in np.split(packed, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int32()), pa.array(data, pa.binary())], names=["block", "counts"])

        for b in slices(batches, "text", 1 << 20):
            *_, (_, _, marks) = _phrases(_Words(b.column("text").to_pylist(), b.column("lang").to_pylist()), filters, n)
            if len(marks[0]):
                held.append((marks[0] & np.uint64(bits - 1)).view(np.int64))
                size += len(held[-1])
            if size >= POSITIONS:
                yield send()
                held, size = [], 0
        if held:
            yield send()
    return run


def _full_buckets(least: int, size: int) -> callable:
    """Bits of the buckets that have ``least`` phrases; rows come by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None

        def bits() -> pa.RecordBatch:
            made = np.packbits(total >= min(least, _MOST), bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([made], pa.binary())], names=["block", "bits"])

        for b in batches:
            for here, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                if here != block:
                    if block is not None:
                        yield bits()
                    block, total = here, np.zeros(size, np.int64)
                packed = np.frombuffer(counts, "<u4")
                total[packed >> 32 - BLOCK_BITS] += packed & _MOST
        if block is not None:
            yield bits()
    return run


def _filter(rows: DataFrame, n: int, sent: list, least: int, bits: int) -> bytes:
    """The filter of the phrases of n words: ``bits`` / 8 bytes however many
    there are, put together from its blocks."""
    size = min(bits, 1 << BLOCK_BITS)
    blocks = (rows.mapInArrow(_bucket_counts(n, sent, bits), "block int, counts binary").repartition("block").sortWithinPartitions("block")
              .mapInArrow(_full_buckets(least, size), "block int, bits binary"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.collect():
        out[r.block * size // 8:(r.block + 1) * size // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.tobytes()


# -- exact counts ------------------------------------------------------------------


def _counts(sent: list, longest: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [np.frombuffer(s.value, np.uint8) for s in sent]
        counts, size = {}, 0

        def send() -> pa.RecordBatch:
            groups = {}
            for (lang, phrase), f in counts.items():
                groups.setdefault((zlib.crc32(phrase) ^ zlib.crc32(lang.encode())) % GROUPS, []).append((lang, phrase.decode(), f))
            cols = [list(map(list, zip(*rows))) for rows in groups.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int32()), *[pa.array([c[i] for c in cols], pa.list_(t)) for i, t in
                                                                                   enumerate((pa.string(), pa.string(), pa.int64()))]], names=["group", "lang", "phrase", "f"])

        for b in slices(batches, "text", 1 << 20):
            langs = b.column("lang").to_pylist()
            words = _Words(b.column("text").to_pylist(), langs, twice=True)
            for text, n in zip(*(x.tolist() for x in np.unique(words.text, return_counts=True))):
                counts[langs[text], b""] = counts.get((langs[text], b""), 0) + n
            for n, at, marks in _phrases(words, filters, longest):
                if n <= len(filters):
                    keep = np.flatnonzero(_in_filter(filters[n - 1], marks[0]))
                    at, marks = at[keep], [m[keep] for m in marks]
                if not len(at):
                    break
                # Equal phrases side by side; those with equal first hashes differ in the second.
                order = np.argsort(marks[0])
                first = np.flatnonzero(np.concatenate([[True], (np.diff(marks[0][order]) != 0) | (np.diff(marks[1][order]) != 0)]))
                here = at[order[first]]
                for text, a, z, f in zip(words.text[here].tolist(), words.start[here].tolist(), words.end[here + n - 1].tolist(), np.diff(first, append=len(at)).tolist()):
                    key = langs[text], words.data[a:z] if n == 1 else b" ".join(words.data[a:z].split())
                    if key in counts:
                        counts[key] += f
                    else:
                        counts[key] = f
                        size += z - a
            if len(counts) >= PHRASES or size >= PHRASE_BYTES:
                yield send()
                counts, size = {}, 0
        if counts:
            yield send()
    return run


def _added_up(least: int) -> callable:
    """Counts of the phrases of each group over all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, counts = None, {}

        def done() -> pa.RecordBatch:
            kept = [(lang, phrase, f) for (lang, phrase), f in counts.items() if f >= least or not phrase]
            cols = list(zip(*kept)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])

        for b in batches:
            for here, *cols in zip(*(b.column(n).to_pylist() for n in ("group", "lang", "phrase", "f"))):
                if here != group:
                    yield done()
                    group, counts = here, {}
                for lang, phrase, f in zip(*cols):
                    counts[lang, phrase] = counts.get((lang, phrase), 0) + f
        yield done()
    return run


def count_stream(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, f) of the phrases of 1 to ``longest`` words that occur
    ``least`` times, and the number of words as the count of the empty
    phrase."""
    spark = docs.sparkSession
    rows = pick(docs, lang="string", text="string").fillna({"lang": "und", "text": ""})
    sent = []
    for n in range(1, longest):
        sent.append(spark.sparkContext.broadcast(_filter(rows, n, sent, least, filter_bits)))
    groups = rows.mapInArrow(_counts(sent, longest), "group int, lang array<string>, phrase array<string>, f array<long>")
    return materialize(groups.repartition("group").sortWithinPartitions("group").mapInArrow(_added_up(least), "lang string, phrase string, f long"), "phrases")


# -- streams in lockstep --------------------------------------------------------


def _key(lang: str, words: list[str]) -> tuple:
    return (lang.encode(), *[w.encode() for w in words])


def _split_points(stream: DataFrame, parts: int) -> list[tuple]:
    """Ends of ``parts`` ranges of about equal size, from a bounded sample."""
    total = stream.count()
    step = max(1, total // SAMPLE)
    some = (stream.filter((F.pmod(F.xxhash64("lang", "words"), F.lit(step)) == 0) & (F.length("phrase") <= 200))
            .select("lang", "words").limit(4 * SAMPLE).collect())
    keys = sorted(_key(r.lang, r.words) for r in some)
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def _placed(points: list[tuple]) -> callable:
    """Each row to its range, and as a copy to each later range that its
    extensions reach into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, part, own = [], [], []
            for i, (lang, words) in enumerate(zip(b.column("lang").to_pylist(), b.column("words").to_pylist())):
                key = _key(lang, words)
                first = bisect_right(points, key)
                for p in range(first, bisect_right(points, (*key, _END)) + 1):
                    index.append(i)
                    part.append(p)
                    own.append(p == first)
            rows = b.take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(own), *rows.columns], names=["part", "own", *rows.schema.names])
    return run


def _lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in sort order; each is sent on when its extensions are through,
    with the counts of its first parts and the largest of its extensions."""
    stack, out = [], []  # (range, lang, words, phrase, own, count, counts of its parts, [largest extension])

    def done(entry: tuple) -> None:
        part, lang, words, phrase, own, f, parts, largest = entry
        if own or largest[0]:
            out.append((lang, phrase, f, parts if own else None, largest[0]))

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * 5
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["lang", "phrase", "f", "parts", "extension"])
        out.clear()
        return made

    for b in batches:
        for r in b.to_pylist():
            words, where = r["words"], (r["part"], r["lang"])
            while stack and (stack[-1][:2] != where or len(stack[-1][2]) >= len(words) or stack[-1][2] != words[:len(stack[-1][2])]):
                done(stack.pop())
            if stack and len(stack[-1][2]) == len(words) - 1:
                top = stack[-1]
                top[7][0] = max(top[7][0], r["f"])
                parts = [*top[6], r["f"]]
            else:
                parts = [r["f"]]
            stack.append((*where, words, r["phrase"], r["own"], r["f"], parts, [0]))
        yield batch()
    while stack:
        done(stack.pop())
    yield batch()


def _merged(streams: DataFrame, backwards: bool) -> DataFrame:
    """(lang, phrase, f, parts, extension): the counts of the first 0, 1, ...
    words of each phrase, itself included, and the largest count among its
    extensions by one word, in one range each; last words if ``backwards``."""
    words = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    rows = streams.withColumn("words", F.reverse(words) if backwards else words).select("lang", "words", "phrase", "f")
    spark = streams.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = _split_points(rows, parts)
    return (rows.mapInArrow(_placed(points), "part int, own boolean, lang string, words array<string>, phrase string, f long")
            .repartition(parts, "part").sortWithinPartitions("part", "lang", "words")
            .mapInArrow(_lockstep, "lang string, phrase string, f long, parts array<long>, extension long"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language by the
    score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    Nulls: a null lang is ``und``, a null text an empty one.  Ties in the
    score go by count, then by phrase.  Repeated rows count each.  A language
    without frequent phrases has no rows, and an empty table gives an empty
    result; extra columns are ignored."""
    ready(docs.sparkSession)
    streams = count_stream(docs, least, longest, filter_bits)
    null = F.lit(None)
    ahead = _merged(streams, False).select("lang", "phrase", "f", F.col("parts").alias("heads"), null.cast("array<long>").alias("tails"), "extension")
    back = _merged(streams, True).select("lang", "phrase", "f", null.cast("array<long>").alias("heads"), F.col("parts").alias("tails"), "extension")
    both = (ahead.unionByName(back).filter(F.instr("phrase", " ") > 0).groupBy("lang", "phrase")
            .agg(F.max("f").alias("a"), F.max("heads").alias("heads"), F.max("tails").alias("tails"), F.max("extension").alias("extension"))
            .filter(F.col("extension") < F.col("a")))
    # heads[k] and tails[k] are the counts of the first and last k words, heads[0] of the empty phrase.
    cuts = both.withColumn("n", F.col("heads")[0]).withColumn("cut", F.array_min(F.expr("""
        transform(sequence(1, size(heads) - 2), k -> named_struct(
            'score', (cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0)))
                     div (cast(heads[k] as decimal(38,0)) * cast(tails[size(heads) - 1 - k] as decimal(38,0))),
            'k', k, 'l', heads[k], 'r', tails[size(heads) - 1 - k]))""")))
    scored = cuts.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same by plain counting of every phrase.
OP12_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
sizes(m) AS (VALUES (1), (2), (3), (4), (5)),
grams AS (
    SELECT lang, m, list_slice(ws, i, i + m - 1) AS g, count(*) AS f
    FROM places, sizes WHERE i + m - 1 <= len(ws) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
often AS (SELECT * FROM grams WHERE f >= 100),
inside AS (
    SELECT o.lang, list_slice(o.g, i, i + k - 1) AS g, max(o.f) AS longest
    FROM often o, range(1, 6) a(i), range(2, 5) b(k)
    WHERE k < o.m AND i + k - 1 <= o.m GROUP BY ALL),
cuts AS (
    SELECT o.lang, o.g, o.f AS a, k, l.f AS l, r.f AS r, t.n,
           ((1000::HUGEINT * o.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM often o, range(1, 5) c(k), often l, often r, totals t
    WHERE o.m > 1 AND k < o.m AND l.lang = o.lang AND l.g = list_slice(o.g, 1, k)
      AND r.lang = o.lang AND r.g = list_slice(o.g, k + 1, o.m) AND t.lang = o.lang),
weakest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS cut FROM cuts),
kept AS (
    SELECT w.lang, array_to_string(w.g, ' ') AS phrase, w.a, w.l, w.r, w.n, w.score
    FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.g = w.g
    WHERE w.cut = 1 AND NOT coalesce(100 * i.longest >= 100 * w.a, FALSE)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM ranked WHERE rank <= 2000
"""
