import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quadrangle.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    """Every prefix of every conversation as a list."""
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            given[c].append((turn is not None, turn or 0, role or "", text or ""))
    given = {c: [t[2:] for t in sorted(ts)] for c, ts in given.items()}
    made = {}
    for c, ts in given.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        made[c] = given.get(c - c % 100, [])[:h] + ts[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                kids[tuple(ts[:d - 1])].add(tuple(ts[:d]))
        ends[tuple(ts)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def run(df, rebuild=True):
    got = T.prefix_trie(df, T.fold(F.col("conv_id"), 6) if rebuild else None)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


def made(convs, seed, most=9, step=37):
    r, rows = random.Random(seed), []
    for i in range(convs):
        c = i * step % 700
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["", "é", "yes", "no", "中文 text"])) for t in range(r.randint(1, most))]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_against_brute_force(spark, rebuild):
    # Distinct turn numbers within a conversation, so no ties.
    rows = made(250, 1)
    rows = list({(c, t): (c, t, a, x) for c, t, a, x in rows}.values())
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(6), rebuild) == brute(rows, rebuild)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert run(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_long_conversation_over_many_ranges(spark):
    rows = [(200, t, "user", f"turn {t % 7}") for t in range(3000)] + [(203, t, "user", f"turn {t % 7}") for t in range(2500)] + [(c, 0, "user", "x") for c in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_shared_across_shards(spark):
    """Copies and common beginnings in many blocks of ids: totals cross."""
    rows = []
    for c in range(0, 4000, 7):
        rows += [(c, 0, "system", "common"), (c, 1, "user", f"q{c % 3}"), (c, 2, "assistant", f"a{c % 6}")]
        rows += [(c, 3 + t, "user", "same") for t in range(c % 12)]
    assert run(spark.createDataFrame(rows, SCHEMA), rebuild=False) == brute(rows, rebuild=False)


def test_odd_rows(spark, clashing):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 1, "user", None), (5, 0, None, "a"), (7, 0, "", ""), (7, 3, "user", "x" * 200_000),
            (100, 0, "user", "only base turn"), (101, 0, "user", "b"), (199, 0, "user", "gone"), (320, 5, "user", "no base"), (-3, 0, "user", "negative")]
    got = run(clashing(spark.createDataFrame(rows, SCHEMA)).withColumn("ROLE2", F.lit("clash")))
    assert got == brute(rows)


def test_repeated_rows_and_ties(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(2, 0, "user", "a")] * 3 + [(3, 0, "user", "b"), (3, 0, "user", "a")]
    got = run(spark.createDataFrame(rows, SCHEMA), rebuild=False)
    assert sum(r[3] for r in got if r[1] == 1) == 3 and max(r[1] for r in got) == 3
    assert [r for r in got if r[1] == 3] == [(1, 3, 1, 2, 0, 1, 1, hashlib.sha256(b"1,2").hexdigest())]


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []


def test_queue_spills_and_merges():
    r, q, want = random.Random(4), T.SpillingQueue(held=10, most_runs=3), defaultdict(lambda: [0, 0])
    for level in range(-30, 0):
        for _ in range(40):
            key = (level + r.randint(1, 4), r.randint(0, 3), r.randint(0, 2))
            n, s = r.randint(0, 9), r.randint(0, 99)
            q.push((*key, n, s))
            want[key][0] += n
            want[key][1] += s
        for a in range(4):
            for b in range(3):
                assert q.take((level + 1, a, b)) == tuple(want.pop((level + 1, a, b), [0, 0]))
    assert q.runs


def test_ids_of_one_node_in_many_strings(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 30)
    rows = [(c, 0, "user", "x") for c in range(300)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(4), rebuild=False) == brute(rows, rebuild=False)
