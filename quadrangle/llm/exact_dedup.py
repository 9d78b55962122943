"""Exact duplicates by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks; each chunk is hashed on its own as
a polynomial in a fixed base, modulo two primes, and chunk hashes combine by
length-shifted arithmetic: ``H(ab) = H(a) * base^len(b) + H(b)``.  The
combination is associative, so chunks of a huge text may be hashed anywhere
and combined in any grouping (:func:`combine`, :func:`combine_chunks`).

Texts with equal fingerprint and length are then compared chunk by chunk with
the text of their group's first row; a group in which any chunk differs is
divided by the texts' SHA-256, so a collision cannot merge different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, slices, table, texts

PRIMES = (2147483647, 2147483629)
BASES = (1315423911 % PRIMES[0], 362436069)
CHUNK = 1 << 16
COMPARE_CHUNK = 1 << 20
#: Members of a group that one task compares with the group's first text.
ROWS_PER_SALT = 256
#: Bits of the fixed-size filter of repeated fingerprints (16 MB at most).
FILTER_BITS = 27


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^(n-1), ..., base, 1 modulo prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime), out])
    return out[-n:].copy()


_POWERS: list[np.ndarray] = []


def chunk_hash(data: bytes | memoryview) -> tuple[int, int]:
    """The two hashes of one chunk of at most ``CHUNK`` bytes.  Products stay
    under 2^40 and their sum under 2^56, so one reduction at the end does."""
    if not _POWERS:
        _POWERS.extend(_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES))
    a = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(a @ w[CHUNK - len(a):]) % p for w, p in zip(_POWERS, PRIMES))


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """The hashes of left + right, right being ``right_len`` bytes long."""
    return tuple((h * pow(b, right_len, p) + g) % p
                 for h, g, b, p in zip(left, right, BASES, PRIMES))


def fingerprint(data: bytes) -> tuple[int, int]:
    """The hashes of a whole text, chunk by chunk."""
    h, view = (0, 0), memoryview(data)
    for i in range(0, len(data), CHUNK):
        part = view[i:i + CHUNK]
        h = combine(h, chunk_hash(part), len(part))
    return h


def _packed(h: tuple[int, int]) -> int:
    return h[0] << 31 | h[1]


def combine_chunks(chunks: DataFrame) -> DataFrame:
    """Fingerprints of texts that come as rows (doc_id, chunk_no, chunk):
    chunks are hashed where they lie, and only (hash, length) pairs move.
    Returns doc_id, fingerprint, n_bytes.  Null chunks count as empty."""
    parts = pick(chunks, doc_id="long", chunk_no="long", chunk="binary")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "chunk"):
            data = [x or b"" for x in b.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("chunk_no"), pa.array([_packed(fingerprint(x)) for x in data], pa.int64()),
                 pa.array(map(len, data), pa.int64())], names=["doc_id", "chunk_no", "h", "n"])

    def joined(key, batch):
        rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("chunk_no", "h", "n"))))
        h, total = (0, 0), 0
        for _, g, n in rows:
            h, total = combine(h, (g >> 31, g & (1 << 31) - 1), n), total + n
        return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "fingerprint": pa.array([_packed(h)], pa.int64()),
                         "n_bytes": pa.array([total], pa.int64())})

    return (parts.mapInArrow(hashed, "doc_id long, chunk_no long, h long, n long")
            .groupBy("doc_id").applyInArrow(joined, "doc_id long, fingerprint long, n_bytes long"))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        data = [x.encode() for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([_packed(fingerprint(x)) for x in data], pa.int64()), pa.array(map(len, data), pa.int64()),
             pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())],
            names=["doc_id", "fingerprint", "n_bytes", "text_sha256"])


def _repeated_filter(multi: DataFrame) -> bytes:
    """A bitmap of 2^FILTER_BITS bits with the slot of every repeated
    fingerprint set: its size is fixed, whatever the corpus.  A full bitmap
    lets every row through; it never holds one back."""
    slot = F.col("fingerprint").bitwiseAND((1 << FILTER_BITS) - 1)
    words = (multi.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(fingerprint & 63 AS int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas())
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.tobytes()


def _chunks_of_repeated(bits) -> callable:
    """Chunks of the texts whose fingerprint's slot is set in the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(bits.value, np.int64)
        for b in slices(batches, "text"):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                data = text.encode()
                f = _packed(fingerprint(data))
                slot = f & (1 << FILTER_BITS) - 1
                if int(words[slot >> 6]) >> (slot & 63) & 1:
                    rows += [(doc, f, len(data), i // COMPARE_CHUNK, data[i:i + COMPARE_CHUNK])
                             for i in range(0, len(data), COMPARE_CHUNK)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["doc_id", "fingerprint", "n_bytes", "chunk_no", "chunk"])
    return run


def _differing(docs: DataFrame, multi: DataFrame) -> DataFrame:
    """(fingerprint, n_bytes) of the groups in which some chunk differs from
    that of the group's first row.  Members of a large group are salted, the
    first row's chunks repeated for each salt."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_repeated_filter(multi))
    chunks = texts(docs).mapInArrow(_chunks_of_repeated(bits), "doc_id long, fingerprint long, n_bytes long, chunk_no long, chunk binary")
    salts = F.ceil(F.col("size") / F.lit(ROWS_PER_SALT)).cast("int")
    member = chunks.join(multi.select("fingerprint", "n_bytes", "keep_id", salts.alias("salts")), ["fingerprint", "n_bytes"])
    member = materialize(member, "exact-members")
    rep = (member.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
           .dropDuplicates(["fingerprint", "n_bytes", "chunk_no"])
           .select("fingerprint", "n_bytes", "chunk_no", F.col("chunk").alias("rep_chunk"),
                   F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    salted = member.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    return (salted.join(rep, ["fingerprint", "n_bytes", "chunk_no", "salt"], "left")
            .filter(~F.col("chunk").eqNullSafe(F.col("rep_chunk")))
            .select("fingerprint", "n_bytes").distinct())


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256,
    n_bytes, fingerprint.

    Nulls: a null text counts as empty (empty texts equal each other); a null
    doc_id stays only where no row of its group has an id.  Ties: of repeated
    rows with the largest doc_id exactly one is kept.  An empty table gives an
    empty result.  Extra columns are ignored."""
    base = materialize(texts(docs).mapInArrow(_fingerprints, "doc_id long, fingerprint long, n_bytes long, text_sha256 string")
                       .withColumn("row", F.monotonically_increasing_id()), "exact-base")
    key = ["fingerprint", "n_bytes"]
    last = F.max(F.struct("doc_id", "row")).alias("last")
    groups = materialize(base.groupBy(*key).agg(last, F.count("*").alias("size")), "exact-groups")
    multi = groups.filter("size > 1").select(*key, F.col("last.doc_id").alias("keep_id"), "size")
    odd = materialize(_differing(docs, multi), "exact-odd")
    # What follows divides the groups of colliding fingerprints, of which there is hardly ever one.
    halves = base.join(odd, key).groupBy(*key, "text_sha256").agg(last, F.count("*").alias("size"))
    whole = groups.join(odd, key, "left_anti").withColumn("text_sha256", F.lit(None).cast("string"))
    classes = materialize(whole.unionByName(halves).withColumnRenamed("text_sha256", "only_sha"), "exact-classes")
    return (base.join(classes, key)
            .filter(F.col("only_sha").isNull() | (F.col("only_sha") == F.col("text_sha256")))
            .select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
                    (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256", "n_bytes", "fingerprint"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_bytes", "fingerprint")


OP7_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
