import random
import zlib

import numpy as np
import pytest

from quadrangle.llm import token_counts as C
from quadrangle.llm import token_output as O

public = pytest.importorskip("public_tokenizers")


def strange_texts(n=300):
    r = random.Random(5)
    parts = ["the", " ", "  ", "\n", "\t", "▁", "▁▁", "é", "é", "don't", "123", "...", " ", " ", "\x1c", "\x85", "😀", "ﬁ", "<s>", "</s>", "<unk>", "<|endoftext|>", "ß", "中文", "a" * 40,
             "\x00", "'ll", "_", "x_y", "--", "word.", "été, ", "A:b", "é!", "it's.", "a;", "?z", "\u0142.", "\u00d7", "n\u0303.", "​", "ver"]
    return ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_units_give_the_library_ids(library):
    enc = O.Encoder(public.path("byte_bpe_50k.json"), most_bytes=12_000)  # a small memory, so generations change
    texts = strange_texts()
    for i in range(0, len(texts), 20):
        for t, ids in zip(texts[i:i + 20], enc.encode(texts[i:i + 20])):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_repeated_units_are_looked_up_once_a_batch(library):
    class Counted(dict):
        got = 0

        def __getitem__(self, unit):
            self.got += 1
            return super().__getitem__(unit)

    enc = O.Encoder(public.path("byte_bpe_50k.json"))
    enc.known = known = Counted()
    text = "the cat, the cat. the cat\n"
    assert [ids.tolist() for ids in enc.encode([text] * 200)] == [library.encode(text, add_special_tokens=False).ids] * 200
    assert known.got == len(known) == 6


def test_units_of_all_sizes(library):
    """Units that differ in one byte, by a zero byte at the end, or beyond the bytes compared at once."""
    words = ["é" * (n % 2) + "a" * n + end for n in (*range(18), *range(60, 68), 300) for end in ("", "b", "\x00", "\x00\x00", "中")]
    texts = [" ".join(words), "\n".join(reversed(words)), "", " \u2003".join(words), "   "]
    enc = O.Encoder(public.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert [ids.tolist() for ids in enc.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_cut_where_units_begin(library, monkeypatch):
    monkeypatch.setattr(O, "_LONG_TEXT", 40)
    enc = O.Encoder(public.path("byte_bpe_50k.json"))
    for t in [*strange_texts(200), "  \n  word" * 100, "x" * 500, " " * 500]:
        assert "".join(O._parts(t, 40)) == t
        assert enc.encode([t, "end"])[0].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("ids", [[], [0], [255, 256], [2] * 513, list(range(0, 70_000, 7)), [2 ** 32 - 1, 0, 65536, 1]])
def test_code_round_trip_and_random_access(ids):
    seg = O.Segment(O.encode_ids(np.array(ids, np.uint32)))
    assert seg.all().tolist() == ids and len(seg) == len(ids)
    assert [seg[i] for i in range(0, len(ids), max(1, len(ids) // 700))] == ids[::max(1, len(ids) // 700)]
    with pytest.raises(IndexError):
        seg[len(ids)]


def expected(rows, library):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_file_of_odd_rows(spark, odd, odd_rows, clashing, library, tmp_path):
    for k, docs in enumerate((odd, clashing(odd))):
        path = f"{tmp_path}/{k}"
        O.write_tokens(docs, path)
        got = sorted((tuple(r) for r in O.read_documents(spark, path).collect()), key=lambda r: r[1])
        assert got == expected(odd_rows, library)
    total = sum(r[2] for r in got)
    every = np.concatenate([np.array([*library.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0]))])
    places = [0, 1, 5, total // 2, total - 1]
    single = {r.position: r.id for r in O.read_tokens(spark, path, spark.createDataFrame([(p,) for p in places], "position long")).collect()}
    assert single == {p: int(every[p]) for p in places}


def test_empty_file(spark, docs_of, tmp_path):
    O.write_tokens(docs_of([]), f"{tmp_path}/none")
    assert O.read_documents(spark, f"{tmp_path}/none").collect() == []


def test_order_of_written_files(spark, docs_of, tmp_path):
    rows = [(i, f"text {i}") for i in (5, 3, 9, 1, 7)]
    docs_of(rows).coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    O.write_tokens(docs, f"{tmp_path}/tokens", order_by=O.written_order(docs))
    assert [r.doc_id for r in O.read_documents(spark, f"{tmp_path}/tokens").orderBy("start").collect()] == [5, 3, 9, 1, 7]
    assert O.written_order(docs_of(rows)) is None


def test_pieces_by_pre_token():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    for t in strange_texts(600):
        assert sum(C.piece_counts(C.VOCABULARY, C.pre_tokens(t))) == len(sp.encode(t)), repr(t)


@pytest.mark.parametrize("frequent", [1, C.FREQUENT])
def test_counts_of_odd_rows(odd, odd_rows, clashing, frequent):
    """With frequent pre-tokens sent to the tasks, and with nearly all joined."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = sorted((str(i), len((t or "").encode()), n, n > 4096) for i, t in odd_rows for n in [len(sp.encode(t or ""))])
    for docs in (odd, clashing(odd)):
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in C.token_counts(docs, frequent=frequent).collect()) == want


def test_counts_of_no_rows(docs_of):
    assert C.token_counts(docs_of([])).collect() == []
