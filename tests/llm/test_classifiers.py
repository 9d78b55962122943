import random
import zlib

import numpy as np
import pytest

from quadrangle.llm import quality as Q
from quadrangle.llm import toxicity as X

SYLLABLES = "an er on ti in ha re nd the st en at or ed".split()


def word(r):
    return "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n)) + "."


BAD = ["grubbling", "quizzlump", "vexatrop", "fumblejox", "wickpazz"]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    rows, labels = [], []
    for i in range(700):
        words = prose(r, r.randint(40, 300)).split()
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for w in r.choices(BAD, k=r.randint(4, 9)):
                words.insert(r.randrange(len(words)), w)
        text = " ".join(words) if good else (" | ".join(words) if i % 8 else " ".join(w + "%%%" for w in words))
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture
def tables(spark, docs_of, corpus):
    return docs_of(corpus[0]), spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int")


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(0)
    bags = [rng.standard_normal((k, Q.FEATURES)).astype(np.float32) for k in (1, 3, 2)]
    y = np.array([1.0, 0.0, 1.0])
    model = Q.fit(bags, np.ones(3))
    model.weights = {k: (rng.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in model.weights.items()}
    x, counts = np.concatenate(bags).astype(np.float64), np.array([1, 3, 2])
    loss = lambda: -np.mean(y * np.log(p := model._forward(x, counts)["p"]) + (1 - y) * np.log(1 - p))
    g = model._gradient(x, counts, y)
    for k, w in model.weights.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 4)]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_passages_cover_whole_texts():
    data = [b"", b"a b c" * 2000, "é".encode() * 500, b"word word word " * 100]
    x, counts = Q.encode_passages(data)
    assert counts.tolist() == [1, -(-10_000 // Q.PASSAGE), -(-1000 // Q.PASSAGE), -(-1500 // Q.PASSAGE)]
    assert not x[0].any() and np.isfinite(x).all()
    alone = np.concatenate([Q.encode_passages([d])[0] for d in data])
    assert np.allclose(alone[:, :Q.CLASSES], x[:, :Q.CLASSES], atol=2e-3)


def test_quality_held_out_accuracy(tables, corpus):
    got = Q.quality_scores(*tables).collect()
    label = {i: q for i, q, _ in corpus[1]}
    assert {r.doc_id for r in got if r.held_out} == {i for i in label if zlib.crc32(str(i).encode()) % 3 == 1}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = {r.doc_id for r in Q.keep_good(*tables).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_toxicity_held_out_accuracy(tables, corpus):
    got = X.toxicity_scores(*tables).collect()
    label = {i: t for i, _, t in corpus[1]}
    assert {r.doc_id for r in got if r.held_out} == {i for i in label if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_labels_of_held_out_rows_change_nothing(spark, tables, corpus):
    docs, labels = tables
    other = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t)
                                   for i, q, t in corpus[1]], "doc_id long, quality int, toxic int")
    for f in (Q.quality_scores, X.toxicity_scores):
        assert sorted(map(tuple, f(docs, labels).collect())) == sorted(map(tuple, f(docs, other).collect()))


@pytest.mark.parametrize("f, column", [(Q.quality_scores, "quality"), (X.toxicity_scores, "toxic")])
def test_odd_rows(spark, docs_of, odd, odd_rows, clashing, f, column):
    some = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (5, 0), (9, 1)], f"doc_id long, {column} int")
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    for docs in (odd, clashing(odd)):
        for labels in (some, none):
            got = f(docs, labels).collect()
            assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)
            assert all(0 <= r.score <= 1 for r in got)
    assert f(docs_of([]), some).collect() == []


def test_blocks_of_a_long_text_are_put_together(monkeypatch):
    r = random.Random(2)
    texts = [prose(r, 4000), "", "x" * 5000, prose(r, 10), " " + "y" * 4000]
    rng = np.random.default_rng(1)
    model = Q.fit([rng.standard_normal((3, Q.FEATURES)).astype(np.float32) for _ in range(4)], np.array([0.0, 1.0, 0.0, 1.0]))
    monkeypatch.setattr(Q, "BLOCK", 3 * Q.PASSAGE)
    parts = [list(Q.blocks(t.encode())) for t in texts]
    assert [b"".join(p) for p in parts] == [t.encode() for t in texts] and len(parts[0]) > 5
    for t, p, score in zip(texts, parts, model.score(texts)):
        x = np.concatenate([Q.encode_passages([b])[0] for b in p])
        assert abs(model._forward(model.standard(x), np.array([len(x)]))["p"][0] - score) < 1e-5


def test_memory_of_a_worker_on_a_text_of_50_mb():
    import subprocess
    import sys

    code = """
import resource, numpy as np
from quadrangle.llm import quality as Q
model = Q.fit([np.zeros((3, Q.FEATURES), np.float32)] * 2, np.ones(2))
text = "some words of a long text, " * (50_000_000 // 27)
model.score(["warm up"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
model.score([text])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 250_000  # KB; the text itself and its bytes are 100 MB


def test_one_row_for_each_sampled_id(spark, docs_of):
    docs = docs_of([(1, f"text {i}") for i in range(50)] + [(2, "other"), (2, "other"), (3, "unused label")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 7)], "doc_id long, label int")
    rows = Q.sample_rows(docs, labels, 10, 1000).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(1, 0), (2, 1)]
