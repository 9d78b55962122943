import hashlib
import random
import re
import string

import numpy as np
import pytest

from quadrangle.llm import secrets as S


def brute_base(text):
    """The contract's patterns, word by word."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), "assign", m.end()))
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], S.KINDS.index(s[1])))


def test_base_spans_by_brute_force():
    r = random.Random(4)
    parts = ["token", "Token", "ſecret", "secret", "api_key", "apiKey", "APIKEY", "password", "passwd", "=", ":", " ", "  ", "'", '"', "abc", "abcdefgh", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef",
             "deadbeef" * 4, "Z", "é", "\n", "secret=abc:secret=abcdefghi", ".", "-", "\t"]
    for _ in range(3000):
        t = "".join(r.choices(parts, k=r.randint(0, 12)))
        assert S.base_spans(t) == brute_base(t), repr(t)


WORDS = "the of and nation erting shable ationer tionly hering andes inter ofore reading ention".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture
def rows():
    r = random.Random(8)
    key = lambda n, a: "".join(r.choice(a) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    out, planted = [], {}
    for i in range(120):
        t = prose(r, 200) + " " + "".join(r.choice(WORDS) for _ in range(6))  # a long word of text
        if i % 6 == 0:
            k = key(40 + i % 5 * 8, letters)
            planted[i] = (len(t) + 1, len(t) + 1 + len(k))
            t += " " + k + " " + prose(r, 30)
        out.append((i, t))
    return out, planted


def test_random_keys_are_found_and_text_is_left(docs_of, rows):
    rows, planted = rows
    got = {r.doc_id: r.spans for r in S.secret_spans(docs_of(rows)).collect()}
    found = {i for i, s in got.items() if s}
    assert len(found & set(planted)) >= 0.9 * len(planted)
    assert len(found - set(planted)) <= 1
    for i in found & set(planted):
        assert got[i] == "random:%d:%d" % planted[i]


def test_step_up_threshold():
    counts = {(0, 0): 90, (0, 40): 5, (0, 80): 5, (1, 30): 1, (1, 0): 99}
    # 10 of 100 with p <= 10^-2, RATE 0.01: 10^-2 > 0.01 * 10 / 100; 5 with p <= 10^-4
    assert S.least_bins(counts) == {0: 80}


def test_tests_tell_text_from_keys():
    pairs = np.zeros((128, 128))
    r = random.Random(1)
    t = prose(r, 50_000)
    for a, b in zip(t, t[1:]):
        pairs[ord(a), ord(b)] += 1
    model = S.TextModel.of(pairs)
    assert model.probability("".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(64))) < 1e-2
    assert model.probability("".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(64))) < 1e-6
    p = model.probability("".join(r.choice(WORDS) for _ in range(12)))
    assert p is None or p > 1e-3
    assert model.probability("a" * 40) is None


def test_odd_rows(docs_of, odd, odd_rows, clashing):
    extra = [(20, "é" * 5 + "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" x"), (20, "é" * 5 + "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" x")]
    rows = odd_rows + extra
    for docs in (docs_of(rows), clashing(docs_of(rows))):
        got = S.secret_spans(docs).collect()
        assert len(got) == len(rows)
        want = sorted((str(i), S.sha256_of(brute_base(t or ""))) for i, t in rows)
        assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    hit = next(r for r in got if r.doc_id == 20)
    assert (hit.n_assign, hit.n_access, hit.n_hex) == (1, 0, 1) and hit.spans == "assign:5:54,hex:14:54"
    assert hit.base_sha256 == hashlib.sha256(hit.spans.encode()).hexdigest()
    assert S.secret_spans(docs_of([])).collect() == []


def test_glued_keys_are_found(docs_of):
    """Random keys after a path, after a word, beside another kind of span."""
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    before = ["com/services/T024BE7LD/B0123ABCD/", "org/private/projects/production/keys/", "the-reading-of-another-intention_", "thereadingofanotherintentionandnationanderofthat"]
    rows, planted = [], {}
    for i in range(160):
        t = prose(r, 100) + " "
        if i % 2:
            k = "".join(r.choice(letters) for _ in range(40))
            t += before[i // 2 % 4]
            planted[i] = (len(t), len(t) + 40, i // 2 % 4)
            t += k + " " + prose(r, 20)
        else:
            t += before[1 + i // 2 % 3] + "nationandreadingwithout"
        rows.append((i, t))
    got = {x.doc_id: x.spans for x in S.secret_spans(docs_of(rows)).collect()}
    exact = sum(got[i] == "random:%d:%d" % planted[i][:2] for i in planted if planted[i][2] < 3)
    held = sum(bool(got[i]) and int(got[i].split(":")[1]) < planted[i][1] and int(got[i].split(":")[2].split(",")[0]) > planted[i][0] for i in planted)
    assert exact >= 54 and held >= 72
    assert sum(bool(got[i]) for i in got if i not in planted) <= 2


def test_parts_beside_a_base_span_are_tested():
    assert list(S._outside(0, 100, [(10, "hex", 40), (45, "hex", 60)])) == [(60, 100)]
    assert list(S._outside(0, 50, [(30, "access", 50)])) == [(0, 30)]
    assert list(S._outside(0, 50, [])) == [(0, 50)]


def one_by_one(start, end):
    """All windows of a stretch, in a loop."""
    size = S.SHORTEST
    while size < end - start:
        for i in range(start, end - size, max(1, size // 4)):
            yield i, i + size
        yield end - size, end
        size = size * 7 // 5


@pytest.mark.parametrize("stretch", [64, 1 << 20])
def test_windows_together_against_one_by_one(monkeypatch, stretch):
    monkeypatch.setattr(S, "STRETCH", stretch)
    r, letters = random.Random(3), string.ascii_lowercase
    pairs = np.ones((128, 128)) + 50 * np.eye(128)
    model = S.TextModel.of(pairs)
    alphabets = [letters, string.digits, string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/-_"]
    for _ in range(60):
        n, alphabet = r.randint(21, 400), r.choice(alphabets)
        part = "".join(r.choices(alphabet, k=n)) if r.random() < 0.6 else "".join(r.choices("aeinorst", k=n // 2) + r.choices(alphabet, k=n - n // 2))
        got = [(int(a), int(z), p) for first, last in S._windows(0, n) for a, z, p in zip(first, last, model.probabilities(part, first, last))]
        assert sorted((a, z) for a, z, _ in got) == sorted(one_by_one(0, n))
        for a, z, p in got:
            want = model.probability(part[a:z]) if len(set(part[a:z])) > 4 else None
            assert np.isnan(p) if want is None else abs(p - want) <= 1e-9 * max(want, 1e-12)


def test_a_long_run_takes_time_by_its_length():
    import time

    r = random.Random(8)
    model = S.TextModel.of(np.ones((128, 128)))
    times = []
    for n in (100_000, 400_000):
        run = "".join(r.choices("aeinorstAEINORST019", k=n))  # uniform in no alphabet
        before = time.process_time()
        S.pieces(model, run)
        times.append(time.process_time() - before)
    assert times[1] < 8 * times[0] + 1
