"""Toxicity by compression distance to two zstandard dictionaries.

One dictionary is trained on ordinary text, the other goes on from it with
words of toxic text: those that toxic documents hold far more often than
ordinary ones.  A window is compressed with either; how many bytes the toxic
dictionary saves is its distance.  Windows are runs of ``RUN`` words, every
``STEP`` words, and single words in a fixed context (without which a short
word is below the library's least saving).  Saved bytes are counted over
thresholds, and a logistic calibration, fitted on rows that the dictionaries
haven't seen, turns a document's counts into its score.

Everything is learnt from a bounded sample of labelled rows (``SAMPLE`` rows
of at most ``SAMPLE_BYTES``, by hash order of the id); scoring covers every
word of every row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, pick, slices, table, texts
from .quality import sample_rows

SAMPLE = 8_000
SAMPLE_BYTES = 32_768
DICTIONARY = 65_536
RUN, STEP = 5, 2
LEVEL = 3
#: A word of toxic text: this many standard errors and times more frequent
#: in toxic documents, and in at least so many of them.
DEVIATIONS, TIMES, LEAST = 5.0, 6.0, 3
CUTS = {"run": (2, 3, 4, 6), "word": (1, 2, 3, 4)}
THRESHOLD = 0.3
#: Distances of single words that a worker remembers.
REMEMBERED = 400_000

_WORD = re.compile(r"\w+")


def words(text: str) -> list[bytes]:
    return [w.encode() for w in _WORD.findall(text.lower())]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    context: bytes
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        self._made, self._known = None, {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def saved(self, data: bytes, spans: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each (offset, length)."""
        if self._made is None:
            self._made = _compressor(self.ordinary), _compressor(self.toxic)
        if not len(spans):
            return np.empty(0, np.int32)
        segments = zstandard.BufferWithSegments(data, np.ascontiguousarray(spans, np.uint64).tobytes())
        a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(segments)), np.int32, len(spans)) for c in self._made)
        return a - b

    def _word_distances(self, docs: list[list[bytes]]) -> dict[bytes, int]:
        known = self._known
        new = list({w for ws in docs for w in ws if w not in known})
        if new:
            parts = [self.context + b" " + w + b" " for w in new]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            known.update(zip(new, self.saved(b"".join(parts), np.stack([np.cumsum(sizes) - sizes, sizes], axis=1)).tolist()))
        if len(known) > REMEMBERED:
            self._known = {}
        return known

    def features(self, docs: list[list[bytes]]) -> np.ndarray:
        """Counts of windows by saved bytes, and the most saved, of each text."""
        sizes = np.fromiter((sum(map(len, ws)) + len(ws) for ws in docs), np.int64, len(docs))
        data, spans, counts, at = b"".join(b" " + w for ws in docs for w in ws) + b" ", [], [], 0
        for ws, size in zip(docs, sizes.tolist()):
            n = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
            first = np.arange(0, max(1, len(ws) - RUN + STEP), STEP) if ws else np.empty(0, np.int64)
            ends = np.cumsum(n)
            if ws:
                stop = ends[np.minimum(first + RUN, len(ws)) - 1]
                start = ends[first] - n[first]
                spans.append(np.stack([at + start, stop - start + 1], axis=1))
            counts.append(len(first))
            at += size
        run = self.saved(data, np.concatenate(spans)) if spans else np.empty(0, np.int32)
        known = self._word_distances(docs)
        out, k = [], 0
        for ws, n in zip(docs, counts):
            row = [np.log1p(len(ws))]
            for kind, gains in (("run", run[k:k + n]), ("word", np.fromiter(map(known.__getitem__, ws), np.int32, len(ws)))):
                row += [np.log1p((gains >= cut).sum()) for cut in CUTS[kind]] + [float(np.clip(gains.max(initial=0), 0, 12))]
            out.append(row)
            k += n
        return np.array(out, np.float64).reshape(len(docs), 1 + sum(len(c) + 1 for c in CUTS.values()))

    def score(self, docs: list[list[bytes]]) -> np.ndarray:
        return self.calibrated(self.features(docs))

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _toxic_words(docs: list[list[bytes]], labels: np.ndarray) -> list[bytes]:
    """Words of toxic documents, the most telling ones last."""
    counts = Counter(), Counter()
    for ws, y in zip(docs, labels.tolist()):
        counts[y].update(set(ws))
    n1, n0, found = int(labels.sum()), int((1 - labels).sum()), []
    for w, k in counts[1].items():
        a, b = k / n1, counts[0][w] / n0
        p = (k + counts[0][w]) / (n1 + n0)
        z = (a - b) / np.sqrt(max(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        if k >= LEAST and z >= DEVIATIONS and a * n0 >= TIMES * (counts[0][w] + 1):
            found.append((z, w))
    return [w for _, w in sorted(found)]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little text to train on, that text."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or b" " * 16


def fit(docs: list[list[bytes]], labels: np.ndarray) -> ToxicModel:
    """Dictionaries from two thirds of the rows, calibration on the others.
    Without both labels every text gets their share."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    cut = np.arange(len(docs)) % 3 > 0
    learn = [ws for ws, c in zip(docs, cut) if c]
    plain = [b" " + b" ".join(ws) + b" " for ws, y in zip(learn, labels[cut]) if not y and ws]
    base = _dictionary([d[i:i + 256] for d in plain for i in range(0, len(d), 256) if len(d) - i > 8])
    enough = 0 < labels[cut].sum() < cut.sum()
    toxic = _toxic_words(learn, labels[cut].astype(int)) if enough else []
    tail = base[-64:]  # the last bytes of a dictionary aren't indexed
    x_size = 1 + sum(len(c) + 1 for c in CUTS.values())
    model = ToxicModel(base + tail, base + b" " + b" ".join(toxic) + b" " + tail, base[-4000:-3976] or b"", np.zeros(x_size + 1), np.zeros(x_size), np.ones(x_size))
    model.weights[0] = np.log(share / (1 - share))
    if not toxic or (~cut).sum() < 10:
        return model
    x, y = model.features([ws for ws, c in zip(docs, cut) if not c]), labels[~cut]
    model.center, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    design, w = np.column_stack([np.ones(len(x)), (x - model.center) / model.scale]), model.weights
    for _ in range(30):  # Newton steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        ridge = np.r_[0, np.full(x_size, 0.5)]
        w = w - np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-9), design.T @ (p - y) + ridge * w)
    model.weights = w
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """Fit on :func:`sample_rows` of the given labels (doc_id, label)."""
    rows = sample_rows(docs, labels, sample, SAMPLE_BYTES).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["text"]))
    return fit([words(r["text"]) for r in rows], np.array([r["label"] for r in rows], np.float64))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; labels
    (doc_id, toxic) are learnt from where they aren't held out.

    Nulls: a null text counts as empty, and an empty text gets the score of
    no windows; null ids and repeated rows are kept.  An empty table gives an
    empty result; extra columns are ignored."""
    known = pick(labels, doc_id="long", toxic="int").filter(~held_out(F.col("doc_id"))).withColumnRenamed("toxic", "label")
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            if b.num_rows:
                scores = sent.value.score([words(t) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return (texts(docs).mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
