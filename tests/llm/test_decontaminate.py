import random

import numpy as np
import pytest

from quadrangle.llm import decontaminate as D

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "su") for b in ("ban", "dor", "fel", "gim", "hup", "jat", "nix")]


def prose(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_full_table():
    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.randint(1, 6) for _ in range(r.randint(1, 25))] for _ in range(2))
        score, first, end = D.align(np.array(a), np.array(b))
        assert score == brute_align(a, b)
        if score:
            assert brute_align(a, b[first:end]) == score


@pytest.fixture
def tables(spark, docs_of):
    r = random.Random(9)
    items = [(k, prose(r, 40)) for k in range(6)]
    rows, want = [], set()
    for k, ws in items:
        edited = [w if i % 7 else "other" for i, w in enumerate(ws)]  # every seventh word replaced
        for j, copy in enumerate((ws, edited, [w for i, w in enumerate(ws) if i % 9], [w.upper() + "," for w in ws])):
            rows.append((100 * k + j, " ".join(prose(r, 200) + copy + prose(r, 100))))
            want.add((100 * k + j, k))
    rows += [(5000 + i, " ".join(prose(r, 300))) for i in range(30)]
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items], "item_id long, text string")
    return docs_of(rows), bench, want, rows


def test_copies_are_found_and_others_left(tables):
    docs, bench, want, rows = tables
    got = D.contamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = dict(rows)
    full = next(r for r in got if (r.doc_id, r.item_id) == (300, 3))
    assert full.similarity == 1.0 and len(text[300][full.char_start:full.char_end].split()) == 40
    kept = {r.doc_id for r in D.decontaminate(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in want}


def test_blocks_of_items_change_nothing(tables, monkeypatch):
    docs, bench, want, _ = tables
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    assert {(r.doc_id, r.item_id) for r in D.contamination(docs, bench).collect()} == want


def test_odd_rows(spark, odd, clashing, docs_of):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "one two three four five"), (4, "...")], "item_id long, text string")
    for docs in (odd, clashing(odd)):
        assert sorted((r.doc_id, r.item_id) for r in D.contamination(docs, bench).collect()) == [(1, None), (5, None), (5, None)]
    assert D.contamination(docs_of([]), bench).collect() == []
    assert D.contamination(odd, bench.limit(0)).collect() == []
    assert D.decontaminate(odd, bench.limit(0)).count() == odd.count()
    assert D.decontaminate(odd, bench).count() == odd.count() - 3


def test_many_copies_with_one_seed_are_found(spark, docs_of):
    """An edited copy with one intact seed, short items, each in many rows."""
    r = random.Random(5)
    item, short, seven = [f"w{i}" for i in range(15)], ["alpha", "beta", "gamma"], [f"v{i}" for i in range(7)]
    copy = [w if i not in (3, 6, 9, 12) else "other" for i, w in enumerate(item)]  # intact runs of 3, 2, 2, 2, 2
    edge = ["v0", "v1", "v2", "q1", "q2", "q3", "q4"]  # 3 of 7 words
    rows = [(i, " ".join(prose(r, 30) + (copy, short, edge)[i % 3] + prose(r, 30))) for i in range(90)]
    rows += [(1000 + i, " ".join(prose(r, 60))) for i in range(30)]
    # a common phrase, in contexts of its own each time, is no copy
    rows += [(2000 + i, " ".join(prose(r, 30) + ["u1", "u2", "u3"] + prose(r, 30))) for i in range(30)]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(short)), (2, " ".join(seven)), (3, "u0 u1 u2 u3 u4 u5 u6")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.contamination(docs_of(rows), bench).collect()}
    assert got == {(i, i % 3) for i in range(90)}
    assert {x.doc_id for x in D.decontaminate(docs_of(rows), bench).collect()} == {i for i, _ in rows if i >= 1000}
