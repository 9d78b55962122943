import hashlib
from collections import defaultdict

import pytest

from quadrangle.llm import exact_dedup as E


def test_fingerprints_compose():
    data = bytes(range(256)) * 1000
    for cut in (0, 1, 65535, 65536, 65537, len(data)):
        a, b = data[:cut], data[cut:]
        assert E.combine(E.fingerprint(a), E.fingerprint(b), len(b)) == E.fingerprint(data)
    assert E.fingerprint(b"") == (0, 0)
    assert E.fingerprint(b"\0") != E.fingerprint(b"\0\0")
    direct = sum((x + 1) * pow(E.BASES[0], len(data) - 1 - i, E.PRIMES[0]) for i, x in enumerate(data[:3000] + data[3000:])) % E.PRIMES[0]
    assert E.fingerprint(data)[0] == direct


def test_chunk_rows_give_the_text_fingerprint(spark):
    data = b"abc" * 70_000
    rows = [(1, 2, data[150_000:]), (1, 0, data[:100_000]), (1, 1, data[100_000:150_000]), (2, 0, None)]
    got = {r.doc_id: (r.fingerprint, r.n_bytes) for r in E.combine_chunks(spark.createDataFrame(rows, "doc_id long, chunk_no long, chunk binary")).collect()}
    assert got == {1: (E._packed(E.fingerprint(data)), len(data)), 2: (0, 0)}


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return groups


def check(rows, got):
    groups = expected(rows)
    assert len(got) == len(rows)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    for text, ids in groups.items():
        some = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert sorted(str(r.doc_id) for r in some) == sorted(map(str, ids))
        assert {r.keep_id for r in some} == {max(known) if known else None}
        assert {r.group_size for r in some} == {len(ids)}
        kept = [r for r in some if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def test_odd_rows(odd, odd_rows, clashing):
    check(odd_rows, E.exact_dedup(odd).collect())
    check(odd_rows, E.exact_dedup(clashing(odd)).collect())


def test_empty_table(docs_of):
    assert E.exact_dedup(docs_of([])).collect() == []


@pytest.mark.parametrize("salt_rows", [1, 256])
def test_collisions_never_merge_texts(docs_of, monkeypatch, salt_rows):
    monkeypatch.setattr(E, "ROWS_PER_SALT", salt_rows)
    rows = [(i, ["abcd", "efgh", "ijkl"][i % 3]) for i in range(30)] + [(100, "solo"), (101, "abcde")]
    # All texts of one length collide; workers get the weak hash with the closures.
    weak = lambda batches: _weak(batches)
    monkeypatch.setattr(E, "_fingerprints", weak)
    monkeypatch.setattr(E, "_chunks_of_repeated", lambda bits: _weak_chunks)
    check(rows, E.exact_dedup(docs_of(rows)).collect())


def _weak(batches):
    import hashlib

    import pyarrow as pa

    for b in batches:
        data = [t.encode() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([7] * len(data), pa.int64()), pa.array(map(len, data), pa.int64()),
                                          pa.array([hashlib.sha256(x).hexdigest() for x in data])], names=["doc_id", "fingerprint", "n_bytes", "text_sha256"])


def _weak_chunks(batches):
    import pyarrow as pa

    for b in batches:
        data = [t.encode() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([7] * len(data), pa.int64()), pa.array(map(len, data), pa.int64()),
                                          pa.array([0] * len(data), pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "fingerprint", "n_bytes", "chunk_no", "chunk"])
