import hashlib

import numpy as np
import pytest

from quadrangle.llm import weighted_sampling as W


def jaccard(a, b):
    """Generalised Jaccard similarity of the bags of word shingles."""
    def bag(t):
        w, out = t.split(), {}
        n = min(len(w), W.WORDS)
        for i in range(len(w) - n + 1 if w else 0):
            k = tuple(w[i:i + n])
            out[k] = out.get(k, 0) + 1
        return out
    a, b = bag(a), bag(b)
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / max(1, sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))


def brute(rows):
    """Every row by itself, in the order of doc_id (null first)."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        new = W.edited(t, after)
        f, e, n = W.fingerprint(t), W.fingerprint(new), W.fingerprint(after)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), f.tobytes().hex(), e.tobytes().hex(), W.likeness(f, e), W.likeness(f, n)))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("partitions", [1, 7])
def test_query_form_against_brute_force(spark, sf_docs, partitions):
    got = W.fingerprints(spark.createDataFrame(sf_docs, "doc_id long, text string").repartition(partitions)).collect()
    assert by_id(got) == by_id(brute(sf_docs))


@pytest.fixture(scope="module")
def sf_docs():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))


def test_odd_rows(spark, odd, odd_rows, clashing):
    got = by_id(W.fingerprints(clashing(odd)).collect())
    # 5 occurs twice with one text, so any order of the two gives the same rows.
    assert got == by_id(brute(odd_rows))
    marks = {r[0]: r[3] for r in got}
    assert marks[2] == marks[3] == marks[7] == "0" * 2 * W.SAMPLES
    assert marks[1] == marks[5] != marks[8]


def test_repeated_ids_with_several_texts(spark):
    rows = [(1, f"text number {i} of the same id") for i in range(40)] + [(2, "the last one of all")]
    got = W.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 41 and sorted(r.fingerprint for r in got) == sorted(W.fingerprint(t).tobytes().hex() for _, t in rows)
    assert sum(r.near_next == 1.0 for r in got) == 0


def test_empty_table_and_single_row(spark):
    schema = "doc_id long, text string"
    assert W.fingerprints(spark.createDataFrame([], schema)).collect() == []
    text = "a b c d e f g h i j"
    got = W.fingerprints(spark.createDataFrame([(4, text)], schema)).collect()
    assert by_id(got) == by_id(brute([(4, text)])) and got[0].near_next == 1.0


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = np.random.default_rng(3)
    off = []
    for _ in range(300):
        h = np.sort(W._mixed(rng.integers(0, 1 << 62, 60).astype(np.uint64)))
        a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
        f, g = W._pair((h, a), (h, b))
        off.append(W.likeness(f, g) - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.055


def test_likeness_estimates_the_similarity_of_texts(sf_docs):
    pairs = [(t, W.edited(t, u)) for (_, t), (_, u) in zip(sf_docs, sf_docs[1:])]
    off = [W.likeness(W.fingerprint(a), W.fingerprint(b)) - jaccard(a, b) for a, b in pairs]
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06


def test_blocks_and_pairs_change_nothing(monkeypatch):
    text = " ".join(f"w{i % 97} x{i % 31}" for i in range(3000))
    whole, other = W.weighted_terms(W.word_hashes(text)), W.weighted_terms(W.word_hashes(text[:9000]))
    alone = W._signature(W._least(*whole)), W._signature(W._least(*other))
    assert all((x == y).all() for x, y in zip(alone, W._pair(whole, other)))
    monkeypatch.setattr(W, "BLOCK", 100)
    monkeypatch.setattr(W, "DRAWN", 7)
    assert (W.fingerprint(text) == alone[0]).all()


def test_hashes_of_the_edited_text():
    words = ["a", "bb", "ccc", "x" * 3000, "é"]
    for i in range(300):
        text, donor = (" ".join(words[(i * 7 + j * j) % 5] * (j % 3) for j in range(i % 23)) + " " * (i % 3) for i in (i, i + 5))
        assert (W._edited_hashes(text, W.word_hashes(text), donor) == W.word_hashes(W.edited(text, donor))).all()
