"""Token ids in directly addressable codes.

Ids are split into chunks of ``CHUNK_BITS`` bits.  Level 0 holds the lowest
chunk of every id; an id with higher chunks has its continuation bit set, and
its next chunk stands on the next level at the rank of that bit.  A rank
directory (ones before each block of ``RANK_BLOCK`` bits) makes the rank a
constant-time lookup, so any id is read without decoding its neighbours.

Segment format (little endian): b"DAC1", u32 levels, then per level u64
length n, n chunk bytes, ceil(n / 8) continuation bytes (bit i of byte i // 8,
lowest first), and ceil(n / RANK_BLOCK) + 1 u32 directory entries; each of
the three arrays is padded to 4 bytes.

A token file is a table of segments (part, seq, start, n_tokens, doc_ids,
doc_starts, payload): parts ascend in document order, segments in a part by
``seq``; ``start`` counts the ids of all documents before the segment.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, scratch_path, slices, table

CHUNK_BITS = 8
RANK_BLOCK = 512
#: Ids after which a segment is closed (a document isn't divided).
SEGMENT_IDS = 1 << 19
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"

# -- the code -----------------------------------------------------------------


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 4)


def encode_ids(ids: np.ndarray) -> bytes:
    """One segment of ids (0 to 2^32 - 1) as directly addressable codes."""
    rest, out, levels = np.asarray(ids, np.uint32), [], 0
    while levels == 0 or len(rest):
        more = (rest >> np.uint32(CHUNK_BITS)) > 0
        bits = np.packbits(more, bitorder="little")
        blocks = -(-len(rest) // RANK_BLOCK)
        whole = np.zeros(blocks * RANK_BLOCK // 8, np.uint8)
        whole[:len(bits)] = bits
        ones = np.bitwise_count(whole).reshape(blocks, RANK_BLOCK // 8).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        out += [struct.pack("<Q", len(rest)), _padded((rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes()),
                _padded(bits.tobytes()), ranks.tobytes()]
        rest, levels = rest[more] >> np.uint32(CHUNK_BITS), levels + 1
    return b"DAC1" + struct.pack("<I", levels) + b"".join(out)


class Segment:
    """Random and whole access to one encoded segment; nothing is decoded on
    opening it."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", payload, 4)[0]):
            n = struct.unpack_from("<Q", payload, at)[0]
            at += 8
            chunks = np.frombuffer(payload, np.uint8, n, at)
            at += n + -n % 4
            size = -(-n // 8)
            bits = np.frombuffer(payload, np.uint8, size, at)
            at += size + -size % 4
            blocks = -(-n // RANK_BLOCK) + 1
            ranks = np.frombuffer(payload, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BLOCK * RANK_BLOCK >> 3
            before = int(np.bitwise_count(bits[first:i >> 3]).sum()) + (int(bits[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
            i, shift = int(ranks[i // RANK_BLOCK]) + before, shift + CHUNK_BITS
        return value

    def all(self) -> np.ndarray:
        out = None
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            if out is not None and len(out):
                value[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= out << np.uint32(CHUNK_BITS)
            out = value
        return out


# -- the tokenizer ------------------------------------------------------------

#: Unicode White_Space, which the vocabulary's splitting pattern calls \s.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Latin letters, all of which the vocabulary's splitting pattern calls \\p{L}.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))

#: Kinds of characters; those from _SPACE_SIGN on end a run.  _END stands for
#: the byte between texts, _LEAD and _INNER for bytes of longer characters.
_OTHER, _LETTER, _SIGN, _SPACE_SIGN, _BLANK, _END, _LEAD, _INNER = range(8)


def _kinds() -> tuple[np.ndarray, bytes]:
    """Kinds of the code points below 0x4000 (the others are _OTHER), and of
    bytes; a byte is _LEAD if the kind depends on those after it."""
    points, of_bytes = np.zeros(0x4000, np.uint8), bytearray(256)
    for kind, pattern in ((_LETTER, _LATIN), (_SIGN, ".,;:!?"), (_BLANK, _SPACE), (_SPACE_SIGN, " ")):
        points[[m.start() for m in re.finditer(f"[{pattern}]", "".join(map(chr, range(0x4000))))]] = kind
    for point in np.flatnonzero(points).tolist():
        of_bytes[chr(point).encode()[0]] = _LEAD if point > 127 else points[point]
    of_bytes[0x80:0xC0], of_bytes[0xFF] = bytes([_INNER]) * 64, _END
    return points, bytes(of_bytes)


_POINT_KINDS, _BYTE_KINDS = _kinds()


def _units(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and size of each unit of the texts in ``data`` (UTF-8, the
    byte 0xFF before the first and after each), and the units in each text.

    The splitting pattern always cuts at these places, so each unit's ids stand
    by themselves: a run of Latin letters with one space before it, where white
    space, the end or one of the signs .,;:!? comes next; else a run of
    characters other than white space with one space before it; or, of a run of
    white space with characters after it, all but the last and, unless it is
    the space of the next unit, the last; or such a run at the end."""
    kind = np.frombuffer(data.translate(_BYTE_KINDS), np.uint8)
    at = np.flatnonzero(kind != _INNER)
    kind = kind[at]
    long = np.flatnonzero(kind == _LEAD)
    if len(long):
        raw = np.frombuffer(data, np.uint8)
        a, b, c = (raw[np.minimum(at[long] + i, len(raw) - 1)].astype(np.intp) & 0x3F for i in range(3))
        kind[long] = _POINT_KINDS[np.where(raw[at[long]] < 0xE0, (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c)]
    gap, end = kind >= _SPACE_SIGN, kind == _END
    first = np.ones(len(kind), bool)
    first[1:] = np.where(gap[1:], ~gap[:-1] | end[:-1] | end[1:], gap[:-1] & (kind[:-1] != _SPACE_SIGN))
    first[:-1] |= gap[:-1] & ~gap[1:]
    # Signs right after the letters that a run begins with.
    stops = np.flatnonzero(kind != _LETTER)
    first[stops[1:][(kind[stops[1:]] == _SIGN) & gap[stops[:-1]] & (np.diff(stops) > 1)]] = True
    first = np.flatnonzero(first)
    ends = np.flatnonzero(end[first])
    starts, real = at[first], ~end[first][:-1]
    return starts[:-1][real], np.diff(starts)[real], np.diff(ends) - 1


#: Units of more bytes aren't compared by ``_numbered``.
_LONGEST = 63
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")


def _numbered(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 on for each unit, the same for equal ones (those beyond
    ``_LONGEST`` bytes have one each), and a unit of each number.  Seven bytes
    with the size are numbered first, then eight at a time with the number of
    what stands before them."""
    words = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    number, found = pd.factorize(words[starts] & _MASKS[np.minimum(sizes, 7)] | np.minimum(sizes, _LONGEST + 1).astype(np.uint64) << np.uint64(56))
    count, done, rest = len(found), 7, np.flatnonzero(sizes > 7)
    while done < _LONGEST and len(rest):
        word, _ = pd.factorize(words[starts[rest] + done] & _MASKS[np.minimum(sizes[rest] - done, 8)])
        of_both, found = pd.factorize(number[rest] << 32 | word)
        number[rest] = of_both + count
        count, done = count + len(found), done + 8
        rest = rest[sizes[rest] > done]
    number[rest] = count + np.arange(len(rest))
    some = np.full(count + len(rest), -1)
    some[number] = np.arange(len(number))
    used = some >= 0
    return (np.cumsum(used) - 1)[number], some[used]


#: Longer texts are cut before white space, where a unit always begins.
_LONG_TEXT = 1 << 21
_CUT = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")


def _parts(text: str, most: int) -> Iterator[str]:
    at = 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    """Ids of texts by the ``tokenizers`` library, which sees each distinct
    unit once as long as the memory of units holds it (looked up once for all
    its places in a batch): two generations of
    about ``most_bytes`` each, whatever the texts are.  Texts with a special
    string in them go to the library whole."""

    #: What an entry takes besides its characters and ids: two objects and its place.
    ENTRY = 220

    def __init__(self, path: str, most_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Ids whose bytes begin with a space (the byte-level alphabet's sign for it).
        self.spaced = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.spaced[[i for t, i in self.library.get_vocab().items() if t[0] == "Ġ"]] = True
        self.most_bytes, self.size, self.known, self.older = most_bytes, 0, {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.asarray(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if any(s in t for s in self.special)
               else np.concatenate([self._encode([p])[0] for p in _parts(t, _LONG_TEXT)]) if len(t) > _LONG_TEXT else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._encode([texts[i] for i in rest])):
            out[i] = ids
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        data = b"\xff" + b"".join(t.encode() + b"\xff" for t in texts)
        starts, sizes, in_text = _units(data)
        number, some = _numbered(data, starts, sizes)
        got = self._unit_ids([data[a:b] for a, b in zip(starts[some].tolist(), (starts + sizes)[some].tolist())])
        counts = np.fromiter(map(len, got), np.int64, len(got)) // 4
        # The ids of each unit in its place: from where its number's ids begin, one after the other.
        begin, n = (np.cumsum(counts) - counts)[number], counts[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(got), "<u4")[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum(in_text)])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _unit_ids(self, units: list[bytes]) -> list[bytes]:
        known = self.known
        new = [u for u in units if u not in known]
        got = {u: self.older[u] for u in new if u in self.older}
        got |= self._library_ids([u for u in new if u not in got])
        known.update(got)
        out = list(map(known.__getitem__, units))
        self.size += len(got) * self.ENTRY + sum(map(len, got)) + sum(map(len, got.values()))
        if self.size > self.most_bytes:
            # One batch alone may be beyond the bound; then nothing is kept of it.
            self.older = known if self.size <= 2 * self.most_bytes else {}
            self.known, self.size = {}, 0
        return out

    def _library_ids(self, new: list[bytes], step: int = 256) -> dict[bytes, bytes]:
        """Ids of each unit.  Units with their space go to the library strung
        together - it cuts before each space - and each begins with the one id
        in it that has a space; the others go one by one."""
        out, units = {}, [u.decode() for u in new]
        strung = [u for u in units if u[0] == " " and len(u) > 1 and u[1] not in _WHITE]
        parts = [strung[i:i + step] for i in range(0, len(strung), step)]
        for i in range(0, len(parts), 8):
            some = parts[i:i + 8]
            for part, e in zip(some, self.library.encode_batch_fast(["".join(p) for p in some], add_special_tokens=False)):
                ids = np.asarray(e.ids, "<u4")
                starts = np.flatnonzero(self.spaced[ids])
                if len(starts) != len(part):
                    raise AssertionError("a unit has more than one space")
                data, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), len(ids) * 4]
                out.update((u, data[a:b]) for u, a, b in zip(part, (starts * 4).tolist(), ends))
        # Those without white space, strung together by line ends.
        line_end = np.asarray(self.library.encode("\n", add_special_tokens=False).ids, "<u4")
        plain = [u for u in units if u not in out and _WHITE.isdisjoint(u)] if len(line_end) == 1 else []
        for i in range(0, len(plain), step):
            part = plain[i:i + step]
            ids = np.asarray(self.library.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == line_end[0])
            if len(ends) != len(part) - 1:
                raise AssertionError("a unit has a line end")
            data, starts = ids.tobytes(), [0, *((ends + 1) * 4).tolist()]
            out.update((u, data[a:b]) for u, a, b in zip(part, starts, [*(ends * 4).tolist(), len(data)]))
        single = [u for u in units if u not in out]
        for i in range(0, len(single), step):
            part = single[i:i + step]
            out.update((u, np.asarray(e.ids, "<u4").tobytes()) for u, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)))
        return {b: out[u] for b, u in zip(new, units)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder of a vocabulary file, by name or path."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if name not in _ENCODERS:
        if not os.path.isabs(name):
            import public_tokenizers

            _ENCODERS[name] = Encoder(public_tokenizers.path(name))
        else:
            _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


# -- the file -----------------------------------------------------------------

_SEGMENTS = "part long, seq long, n_tokens long, doc_ids array<long>, doc_starts array<long>, payload binary"


def _segments(name: str, end_id: int | None) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(name), TaskContext.get().partitionId(), 0
        docs, starts, pieces, size = [], [], [], 0
        end = [] if end_id is None else [np.asarray([end_id], np.uint32)]

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(pieces) if pieces else np.empty(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                 pa.array([starts], pa.list_(pa.int64())), pa.array([encode_ids(ids)], pa.binary())],
                names=["part", "seq", "n_tokens", "doc_ids", "doc_starts", "payload"])

        for b in slices(batches, "text", 2 << 20):
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                docs.append(doc)
                starts.append(size)
                pieces += [ids, *end]
                size += len(ids) + len(end)
                if size >= SEGMENT_IDS:
                    yield segment()
                    docs, starts, pieces, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield segment()
    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int | None = END_ID,
                 order_by: list[Column] | None = None) -> None:
    """Encode ``docs`` (doc_id, text) in the given order, doc_id by default,
    and write the token file at ``path``.  The order's range partitioning is
    the only shuffle; segments are written where they are made.

    Nulls: a null text is an empty one; null ids come first.  Repeated rows
    are each written; ties stand in the order of their texts' hashes.  An
    empty table gives a file without segments.  Extra columns are ignored."""
    if order_by is None:
        rows = pick(docs, doc_id="long", text="string").fillna({"text": ""})
        order = [F.col("doc_id"), F.xxhash64("text")]
    else:
        names = [f"_order{i}" for i in range(len(order_by))]
        both = docs.select(*[c.alias(n) for c, n in zip(order_by, names)], "*")
        rows = pick(both, doc_id="long", text="string", **{n: f.dataType.simpleString() for n, f in zip(names, both.schema)}).fillna({"text": ""})
        order = [F.col(n) for n in names]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
     .mapInArrow(_segments(vocabulary, end_id), _SEGMENTS).write.parquet(path))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with their ``start``, the ids of all documents before.
    The running sum over parts has one row for each part of the file; within
    a part it goes over that part's segments."""
    rows = spark.read.schema(_SEGMENTS).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.select("part", "seq", "n_tokens").withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
              .join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("inner")).alias("start")))
    return rows.join(starts, ["part", "seq"])


def written_order(docs: DataFrame) -> list[Column] | None:
    """The order in which the rows of ``docs`` stand in the files that it is
    read from, numbered files by number; None if it isn't read from files."""
    file = F.col("_metadata.file_path")
    order = [F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_path, 'part-([0-9]+)[^/]*$', 1) AS long)"), F.lit(0)), file, F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        return None
    return order


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "payload", 4 << 20):
        for row in b.to_pylist():
            ids, starts = Segment(row["payload"]).all(), row["doc_starts"]
            ends = [*starts[1:], len(ids)]
            raw = memoryview(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([row["start"] + s for s in starts], pa.int64()),
                 pa.array([e - s for s, e in zip(starts, ends)], pa.int64()),
                 pa.array([zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(starts, ends)], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32, from
    the decoded ids."""
    return read_segments(spark, path).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, id) of single tokens by their positions in the whole file,
    each by random access into its segment."""
    segs = read_segments(spark, path)
    block = F.lit(SEGMENT_IDS)
    covered = segs.filter("n_tokens > 0").select("part", "seq", "start", "n_tokens", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block))).alias("block"))
    wanted = pick(positions, position="long").distinct().withColumn("block", F.floor(F.col("position") / block))
    hit = (wanted.join(covered, "block")
           .filter((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens"))))
    per = hit.groupBy("part", "seq").agg(F.collect_list("position").alias("positions"))

    def access(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                seg = Segment(row["payload"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["positions"], pa.int64()), pa.array([seg[p - row["start"]] for p in row["positions"]], pa.int64())],
                    names=["position", "id"])

    return segs.join(per, ["part", "seq"]).select("payload", "start", "positions").mapInArrow(access, "position long, id long")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return read_documents(spark, path)
