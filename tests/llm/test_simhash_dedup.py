import re

import numpy as np
import pytest
import xxhash

from quadrangle.llm import components as C
from quadrangle.llm import simhash_dedup as S


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, most=4):
    group = list(range(len(fps)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [top(i) for i in range(len(fps))]


def test_fingerprint_is_the_stated_one():
    for t in ("", "  ", "One", "a b c", "A b C d", "a b c d e f A B C D", "é Ü\x0bx\x1cy z w v", "x y " * 500):
        assert S.simhash(t) == brute_fingerprint(t)


def near_fingerprints(seed, centres, each, bits):
    rng, out = np.random.default_rng(seed), set()
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64).tolist():
        for _ in range(each):
            y = c
            for b in rng.integers(0, 64, rng.integers(0, bits + 1)):
                y ^= 1 << int(b)
            out.add(y)
    return sorted(out)


@pytest.mark.parametrize("short, block", [(24, 2048), (2, 2048), (2, 16)])
@pytest.mark.parametrize("bits", [0, 2, 4])
def test_links_connect_what_the_distance_connects(spark, monkeypatch, short, block, bits):
    """Short lists, long lists and lists dealt out in blocks."""
    monkeypatch.setattr(S, "SHORT", short)
    monkeypatch.setattr(S, "BLOCK", block)
    fps = near_fingerprints(3, 4, 60, 5)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    # The functions go to the workers with the module's values bound here.
    got = {r.node: r.component for r in C.components(S.fingerprint_links(nodes, bits)).collect()}
    want = brute_groups(fps, bits)
    label = {}
    for i, f in enumerate(signed):
        label.setdefault(want[i], set()).add(f)
    for members in label.values():
        assert {got.get(f, f) for f in members} == {min(members)}


def test_spanning_between_blocks_equals_all_pairs():
    a, b = (np.array(near_fingerprints(s, 3, 40, 4), np.uint64) for s in (5, 5))
    links = S._spanning(a[::2], b[1::2], 4)
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(*links))


def check(docs, rows):
    got = S.simhash_dedup(docs).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(fps)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    assert sorted((str(i), f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, groups)) == sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got)


def test_odd_rows(odd, odd_rows, clashing):
    check(odd, odd_rows)
    check(clashing(odd), odd_rows)


def test_empty_table(docs_of):
    assert S.simhash_dedup(docs_of([])).collect() == []


def test_one_of_each_group_stays(docs_of):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base.replace("word7 ", "word7 ")), (4, "something else entirely"), (None, base), (11, "")]
    kept = sorted((str(r.doc_id) for r in S.keep_one(docs_of(rows)).collect()))
    assert kept == ["11", "3", "4", "None"]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 1 for k in [1, *range(200, 260)]}}
