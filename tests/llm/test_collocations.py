import random
from collections import Counter, defaultdict

import pytest

from quadrangle.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, longest, top):
    """Every phrase counted, every longer phrase looked at."""
    import re

    counts, out = defaultdict(Counter), []
    for _, text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
    for lang, f in counts.items():
        total = sum(k for g, k in f.items() if len(g) == 1)
        often = {g: k for g, k in f.items() if len(g) > 1 and k >= least}
        found = []
        for g, a in often.items():
            if any(len(o) > len(g) and 100 * k >= 100 * a and any(o[i:i + len(g)] == g for i in range(len(o))) for o, k in often.items()):
                continue
            score, k = min((1000 * a * total // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, total, -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def run(df, **kw):
    return sorted(map(tuple, C.collocations(df, **kw).collect()))


def made(n, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "a", "é", "ÀB", "x\x00y", "中", "in", "1.5", "\x01", "and", "b\xa0c"]
    ends = [" ", "  ", "\t", " ", ". ", ",", "\n", " ", " ", "\x0b"]
    return [(i, "".join(w + r.choice(ends) for w in r.choices(words, range(15, 0, -1), k=r.randint(0, 60))), r.choice(["en", "de", None])) for i in range(n)]


@pytest.mark.parametrize("least, longest, top, bits", [(3, 5, 2000, 1 << 16), (5, 3, 7, 8), (2, 2, 50, 1 << 20)])
def test_against_brute_force(spark, least, longest, top, bits):
    rows = made(120)
    got = run(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, longest=longest, top=top, filter_bits=bits)
    assert got and got == brute(rows, least, longest, top)


def test_small_memory_and_many_ranges_change_nothing(spark, monkeypatch):
    rows = made(90, 2)
    for name, value in (("POSITIONS", 50), ("PHRASES", 3), ("SAMPLE", 10_000)):
        monkeypatch.setattr(C, name, value)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert run(spark.createDataFrame(rows, SCHEMA), least=3) == brute(rows, 3, 5, 2000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark, odd, odd_rows, clashing):
    rows = [(i, t, "en") for i, t in odd_rows]
    assert run(clashing(odd), least=2) == brute(rows, 2, 5, 2000)


def test_repeats_ties_and_overlaps(spark):
    rows = [(1, "ha ha ha ha ha", "en")] * 3 + [(2, "b a. b a. c a. c a", "en"), (2, "b a. b a. c a. c a", "en")]
    got = run(spark.createDataFrame(rows, SCHEMA), least=4)
    assert got == brute(rows, 4, 5, 2000)
    assert {r[2] for r in got} >= {"b a", "c a", "ha ha"}


def test_a_longer_phrase_as_frequent_drops_its_parts(spark):
    rows = [(i, "x one two three y one two three z", "en") for i in range(3)] + [(9, "one two", "en")]
    got = run(spark.createDataFrame(rows, SCHEMA), least=6)
    assert got == brute(rows, 6, 5, 2000) and {r[2] for r in got} == {"one two", "one two three"}  # not "two three"


def test_products_beyond_64_bits(spark):
    n = 3_000_000_019
    streams = spark.createDataFrame([("en", "", 10 ** 14), ("en", "a", 5 * 10 ** 13), ("en", "b", 4 * 10 ** 13 + 1), ("en", "a b", n)], "lang string, phrase string, f long")

    def given(*args, **kw):
        return streams
    old, C.count_stream = C.count_stream, given
    try:
        got = run(spark.createDataFrame([], SCHEMA))
    finally:
        C.count_stream = old
    assert got == [("en", 1, "a b", n, 5 * 10 ** 13, 4 * 10 ** 13 + 1, 10 ** 14, 1000 * n * 10 ** 14 // (5 * 10 ** 13 * (4 * 10 ** 13 + 1)))]


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(None, None, None), (1, "", "en")], SCHEMA), least=1) == []


def test_words_against_splitting():
    import re

    texts = [t for _, t, _ in made(60, 5)] + ["", "...", "a" * 9000 + " " + "a" * 9001, "A\xffB ÿ", None or "x"]
    words = C._Words(texts, ["en", "de"] * 32 + ["en"], twice=True)
    want = [(i, w) for i, t in enumerate(texts) for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for w in re.findall("[^\x20\x09]+", piece)]
    got = [(i, words.data[a:z].decode()) for i, a, z in zip(words.text.tolist(), words.start.tolist(), words.end.tolist())]
    assert got == want
    for marks in words.marks:  # one hash for one word of one language
        of = {}
        for (i, w), m in zip(want, marks.tolist()):
            assert of.setdefault((i % 2, w), m) == m
        assert len(set(of.values())) == len(of)
