"""Token counts without ids: pieces counted once per distinct pre-token.

The vocabulary's merges never join a character with a following space mark,
so a text (a space mark put before it) falls into pre-tokens - a run of space
marks and the characters up to the next one - whose pieces are independent.

1. Pre-token frequencies of the corpus: counted in each task, summed by key.
2. The library counts the pieces of each distinct pre-token once.
3. Per document, pre-token frequencies times pieces are summed.  Pre-tokens
   holding at least 1 / ``frequent`` of all occurrences - at most ``frequent``
   of them, whatever the corpus, and no longer than ``FREQUENT_CHARS`` - are
   sent to the tasks; all others are joined by key.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, texts

VOCABULARY = "piece_bpe_32k.model"
FREQUENT = 2_000_000
FREQUENT_CHARS = 48
#: Distinct pre-tokens that a task holds before it passes them on.
TASK_DISTINCT = 400_000
LIMIT = 4096

_UNIT = re.compile(" +[^ ]*")
_LIBRARY: dict[str, object] = {}


def _library(name: str):
    if name not in _LIBRARY:
        import os

        import sentencepiece

        path = name
        if not os.path.isabs(name):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _LIBRARY[name] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LIBRARY[name]


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens with spaces for space marks; none if it is empty."""
    return _UNIT.findall(" " + text.replace("▁", " ")) if text else []


def piece_counts(name: str, units: list[str]) -> list[int]:
    """Pieces of each pre-token.  The library puts a space mark before what it
    is given, so the first one is left out; alone it is one piece."""
    return [1 if u == " " else len(ids) for u, ids in zip(units, _library(name).encode([u[1:] for u in units], num_threads=1))]


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "freq"])

    for b in slices(batches, "text", 2 << 20):
        for t in b.column("text").to_pylist():
            seen.update(pre_tokens(t))
        if len(seen) >= TASK_DISTINCT:
            yield out()
            seen.clear()
    yield out()


def _count_pieces(name: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = b.column("unit").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("freq"), pa.array(piece_counts(name, units), pa.int64())],
                                             names=["unit", "freq", "pieces"])
    return run


_ROWS = "row long, doc_id long, n_bytes long, known long, unit string, freq long"


def _document_rows(frequent) -> callable:
    """Per document one row with its size and the sum over frequent
    pre-tokens, and a row for each of its other pre-tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, row = frequent.value, TaskContext.get().partitionId() << 40
        for b in slices(batches, "text", 1 << 20):
            rows, ids, sizes, known, units, freqs = [], [], [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                total, rest = 0, []
                for u, f in Counter(pre_tokens(text)).items():
                    n = pieces.get(u)
                    if n is None:
                        rest.append((u, f))
                    else:
                        total += n * f
                k = len(rest)
                # The document's own row has a key that no pre-token has and no other document.
                rows += [row] * (k + 1)
                ids += [doc] + [None] * k
                sizes += [len(text.encode())] + [None] * k
                known += [total] + [None] * k
                units += [f"\0{row}"] + [u for u, _ in rest]
                freqs += [0] + [f for _, f in rest]
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((rows, ids, sizes, known, units, freqs), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))],
                names=["row", "doc_id", "n_bytes", "known", "unit", "freq"])
    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.

    Null texts count as empty (no tokens); null ids and repeated rows are
    kept as they are; an empty table gives an empty result; extra columns are
    ignored.  Every pre-token begins with a space, so the rows' own keys,
    which begin with a null character, never meet one."""
    spark, rows = docs.sparkSession, texts(docs)
    counts = rows.select("text").mapInArrow(_corpus_counts, "unit string, freq long").groupBy("unit").agg(F.sum("freq").alias("freq"))
    pieces = materialize(counts.mapInArrow(_count_pieces(vocabulary), "unit string, freq long, pieces long"), "piece-counts")
    least = -(-(pieces.agg(F.sum("freq")).first()[0] or 0) // frequent)
    common = (F.col("freq") >= max(2, least)) & (F.length("unit") <= FREQUENT_CHARS)
    top = pieces.filter(common).select("unit", "pieces").toPandas()
    sent = spark.sparkContext.broadcast(dict(zip(top["unit"], top["pieces"].tolist())))
    parts = rows.mapInArrow(_document_rows(sent), _ROWS)
    rare = pieces.filter(~common).select("unit", "pieces")
    n = F.coalesce("known", F.lit(0)) + F.col("freq") * F.coalesce("pieces", F.lit(0))
    return (parts.join(rare, "unit", "left").groupBy("row")
            .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(n).alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
