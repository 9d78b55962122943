"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage of the whole text is encoded
(byte classes, hashed byte pairs, word shape and repetition); gated attention
weighs the passages, and the weighted sum of their representations is scored:

    h = tanh(x W + b),  a = softmax(w . (tanh(h V) * sigmoid(h U))),
    score = sigmoid(c . sum(a h) + d)

All weights, attention included, are learnt together from document labels on
a bounded sample of labelled rows (``SAMPLE`` ids, one row each, of at most
``SAMPLE_BYTES``, by hash order of the id); scoring covers every passage of
every row.  A long text is read in blocks of ``BLOCK`` bytes, whose sums for
the attention are put together, so memory doesn't go by its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, pick, slices, table, texts

SAMPLE = 6_000
SAMPLE_BYTES = 32_768
PASSAGE = 768
BLOCK = 256 * PASSAGE
PAIRS = 128
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 30, 64, 0.01

_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t", "\n\r", ".", ",", ";:", "!", "?", "'\"`", "()", "[]{}", "<>",
          "|", "#", "%", "$", "&", "*", "@", "/\\", "-_", "+=~^"]
_CLASS = np.full(256, len(_KINDS), np.int64)  # control characters
for _i, _k in enumerate(_KINDS):
    _CLASS[list(_k.encode())] = _i
_CLASS[128:192], _CLASS[192:] = len(_KINDS) + 1, len(_KINDS) + 2
CLASSES = len(_KINDS) + 3
FEATURES = CLASSES + PAIRS + 7


def encode_passages(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, passages of each text); an empty text has
    one passage of zeros."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not sizes.sum():
        return out, counts
    # A line end after each text keeps words and pairs apart.
    b = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    start = np.cumsum(sizes + 1) - sizes - 1
    doc = np.repeat(np.arange(len(data)), sizes + 1)
    at = np.minimum(np.arange(len(b)) - start[doc], np.maximum(sizes[doc] - 1, 0))
    passage = first[doc] + at // PASSAGE
    length = np.bincount(passage, minlength=total).astype(np.float32)[:, None]
    kind = _CLASS[b]
    out[:, :CLASSES] = np.bincount(passage * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES) / length
    pair = ((b[:-1].astype(np.uint32) * np.uint32(2654435761) ^ b[1:].astype(np.uint32) * np.uint32(2246822519)) >> np.uint32(25)).astype(np.int64)
    inside = np.ones(len(b) - 1, bool)
    inside[(start + sizes)[:-1]] = False  # no pair of one text's end and the next one's beginning
    out[:, CLASSES:CLASSES + PAIRS] = np.sqrt(np.bincount((passage[:-1] * PAIRS + pair)[inside], minlength=total * PAIRS).reshape(total, PAIRS) / length)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(begins)
    if len(starts):
        n = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1 - starts
        # A word's hash: its bytes times odd numbers that go by their place in it.
        place = np.arange(len(b)) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
        odd = np.maximum(place, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        word = np.add.reduceat(np.where(blank, 0, b).astype(np.uint64) * odd, starts)
        of = passage[starts]
        number = np.bincount(of, minlength=total)
        words = np.maximum(1, number)
        mean = np.bincount(of, n, total) / words
        cols = [number / length[:, 0], mean / 8, np.sqrt(np.maximum(0, np.bincount(of, n * n, total) / words - mean * mean)) / 8]
        for d in (1, 2, 3):
            again = np.zeros(len(word))
            again[d:] = (word[d:] == word[:-d]) & (of[d:] == of[:-d])
            cols.append(np.bincount(of, again, total) / words)
        same = np.unique(of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ word, return_index=True)[1]
        cols.append(np.bincount(of[same], minlength=total) / words)
        out[:, CLASSES + PAIRS:] = np.stack(cols, axis=1)
    out[first[sizes == 0]] = 0
    return out, counts


_LAST_BLANK = re.compile(rb".*[ \t-\r]", re.DOTALL)


def blocks(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of at most ``BLOCK`` bytes, cut after the last white
    space in it, if any."""
    at = 0
    while len(text) - at > BLOCK:
        cut = _LAST_BLANK.match(text, at, at + BLOCK)
        end = cut.end() if cut else at + BLOCK
        yield text[at:end]
        at = end
    yield text[at:]


def _groups(texts: list[str]) -> Iterator[list[tuple[int, bytes]]]:
    """(text, block) of all texts, about two blocks' bytes at a time."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for part in blocks(t.encode()):
            group.append((i, part))
            size += len(part)
            if size >= BLOCK:
                yield group
                group, size = [], 0
    if group:
        yield group


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.weights, np.cumsum(counts) - counts
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        a = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(h * a[:, None], at, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, texts: list[str]) -> np.ndarray:
        """Score of each text, from all its passages."""
        w, n = self.weights, len(texts)
        top, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        for group in _groups(texts):
            x, counts = encode_passages([part for _, part in group])
            h = np.tanh(self.standard(x) @ w["W"] + w["b"])
            e = (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["w"]
            at = np.cumsum(counts) - counts
            most = np.maximum.reduceat(e, at)
            e = np.exp(e - np.repeat(most, counts))
            sums, parts = np.add.reduceat(e, at), np.add.reduceat(h * e[:, None], at, axis=0)
            for (i, _), m, s, p in zip(group, most.tolist(), sums.tolist(), parts):
                if m > top[i]:
                    total[i], z[i], top[i] = total[i] * np.exp(top[i] - m), z[i] * np.exp(top[i] - m), m
                total[i] += s * np.exp(m - top[i])
                z[i] += p * np.exp(m - top[i])
        return _sigmoid(z / total[:, None] @ w["c"].astype(np.float64) + w["d"])

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def _gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f, at = self.weights, self._forward(x, counts), np.cumsum(counts) - counts
        dy = (f["p"] - y) / len(y)
        dz = np.repeat(dy[:, None] * w["c"], counts, axis=0)
        dh = f["a"][:, None] * dz
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), counts))
        dg = de[:, None] * w["w"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (dh + dt @ w["V"].T + ds @ w["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> AttentionModel:
    """Adam over all weights; ``bags`` are the passages of each document.
    Without both labels the model gives their share to every text."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    w = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE),
         "c": np.zeros(HIDDEN, np.float32), "d": np.full(1, np.log(share / (1 - share)), np.float32)}
    model = AttentionModel(mean, scale, w)
    if len(set(labels.tolist())) < 2:
        return model
    bags = [model.standard(b) for b in bags]
    m, v, step = {k: 0 * a for k, a in w.items()}, {k: 0 * a for k, a in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            some = order[i:i + BATCH]
            g = model._gradient(np.concatenate([bags[k] for k in some]), np.array([len(bags[k]) for k in some]), labels[some])
            step += 1
            for k in w:
                d = g[k] + 1e-4 * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                w[k] = w[k] - (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 2 << 20):
        x, counts = encode_passages([t.encode() for t in b.column("text").to_pylist()])
        bags = [p.tobytes() for p in np.split(x, np.cumsum(counts)[:-1])]
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(bags, pa.binary())], names=["label", "bag"])


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int, most_bytes: int) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled ids, the first by
    hash of the id, one row each: of an id's labels the least, of its texts,
    if they have at most ``most_bytes``, the first by hash.  Labels other than
    0 and 1 aren't used.  The sampled ids, which the parameter bounds, are
    sent to the scan."""
    chosen = (pick(labels, doc_id="long", label="int").filter(F.col("label").isin(0, 1)).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return (texts(docs).join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text") <= most_bytes)
            .groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("_t")).select("doc_id", F.col("_t.text").alias("text"), "label"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel:
    """Fit on :func:`sample_rows` of the given labels (doc_id, label)."""
    rows = sample_rows(docs, labels, sample, SAMPLE_BYTES).mapInArrow(_encode, "label int, bag binary").toArrow()
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in rows.column("bag").to_pylist()]
    y = np.array(rows.column("label").to_pylist(), np.float64)
    order = sorted(range(len(bags)), key=lambda i: (y[i], bags[i].tobytes()))  # the same at any order of arrival
    return fit([bags[i] for i in order], y[order])


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id and score of every row, from all passages of its text.

    Nulls: a null text counts as empty, and an empty text gets the score of
    one blank passage; null ids and repeated rows are kept.  An empty table
    gives an empty result; extra columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.score(b.column("text").to_pylist()))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; labels
    (doc_id, quality) are learnt from where they aren't held out."""
    known = pick(labels, doc_id="long", quality="int").filter(~held_out(F.col("doc_id"))).withColumnRenamed("quality", "label")
    return (score(docs, train(docs, known))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects (score under
    0.5), all columns kept; a row is decided where it lies.

    Nulls: a null text counts as empty and is decided by the score of one
    blank passage; null ids and repeated rows are decided like any others, by
    their texts alone.  An empty table gives an empty result; of columns whose
    names differ in case only, ``text`` by exact name counts, else the first."""
    known = pick(labels, doc_id="long", quality="int").filter(~held_out(F.col("doc_id"))).withColumnRenamed("quality", "label")
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, known))
    name = next(c for c in [*[c for c in docs.columns if c == "text"], *docs.columns] if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, name, 2 << 20):
            if b.num_rows:
                scores = sent.value.score([t or "" for t in b.column(b.schema.get_field_index(name)).to_pylist()])
                yield b.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
