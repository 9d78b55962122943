import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from quadrangle.llm import source_mix as M


def brute(rows, w, block_rows, period=400):
    """(phase, slot) of every (source, rank), slot by slot."""
    n = Counter(s for _, s in rows)
    ends = sorted({Fraction(n[s], w[s]) for s in n})
    place, lo, first = {}, dict.fromkeys(n, 0), 0
    for phase, x in enumerate(ends, 1):
        active = sorted((s for s in n if Fraction(n[s], w[s]) >= x), key=lambda s: "" if s is None else "=" + s)
        total = sum(w[s] for s in active)
        hi = {s: min(n[s], int(w[s] * x)) for s in active}
        q = {s: max(1, (2 * w[s] * period + total) // (2 * total)) for s in active}
        slots, size = sum(q.values()), sum(hi[s] - lo[s] for s in active)
        periods = max(1, -(-size // (slots * block_rows)))
        done, at = dict.fromkeys(active, 0), defaultdict(list)
        for t in range(slots):
            ready = [s for s in active if done[s] < q[s] and done[s] * slots // q[s] <= t]
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * slots // q[s]), active.index(s)))
            done[s] += 1
            at[s].append(t)
            for z in active:  # less than one block off, at every slot
                assert abs(Fraction(q[z] * (t + 1), slots) - done[z]) < 1
        for s in active:
            for r in range(lo[s], hi[s]):
                b = (r - lo[s]) * (q[s] * periods) // (hi[s] - lo[s])
                place[s, r] = phase, first + b // q[s] * slots + at[s][b % q[s]]
        first, lo = first + slots * periods, {**lo, **hi}
    return place


@pytest.mark.parametrize("weights, block, buckets", [(None, 4, 512), ({"a": 5, "b": 1, "c": 1, "d": 3}, 2, 16), ({"a": 1, "b": 7}, 64, 512)])
def test_places_equal_the_slot_by_slot_schedule(docs_of, monkeypatch, weights, block, buckets):
    monkeypatch.setattr(M, "BUCKET_ROWS", buckets)
    rows = [(i, "abcd"[(i % 7 > 2) + (i % 11 == 3) + (i % 50 == 0)] if i % 97 else None) for i in range(1200)]
    got = M.mix(docs_of([(i, "t", s) for i, s in rows]), weights, block).collect()
    n = Counter(s for _, s in rows)
    w = {s: (max(1, int(1000 * n[s] ** 0.5 + 0.5)) if weights is None else weights.get(s, min(weights.values()))) for s in n}
    ranks = defaultdict(list)
    for i, s in rows:
        ranks[s].append((hashlib.md5(str(i).encode()).hexdigest(), i))
    rank = {i: k for s in ranks for k, (_, i) in enumerate(sorted(ranks[s]))}
    place = brute(rows, w, block)
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    for r in got:
        assert (r.mix_rank, r.mix_phase, r.mix_slot) == (rank[r.doc_id], *place[r.source, rank[r.doc_id]])


def test_odd_rows(docs_of, odd, odd_rows, clashing):
    for docs in (odd, clashing(odd)):
        got = M.mix(docs).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)
        assert sorted(r.mix_rank for r in got) == list(range(len(odd_rows)))
    carried = M.mix(clashing(odd), carry=["text"]).collect()
    assert sorted(str(r.text) for r in carried) == sorted(str(t) for _, t in odd_rows)
    assert M.mix(docs_of([])).collect() == []
    with pytest.raises(ValueError):
        M.mix(odd, {"src0": 0})
