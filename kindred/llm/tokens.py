"""Token-id output: canonical length-limited Huffman codes in independent blocks, and their table-driven decoding."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import byte_slices, chunks, discard, mapped, shared_dir, written

MAGIC = b"KDHF"
HEAD = struct.Struct("<4sBBHIIQ")  # magic, version, longest code, tokens a checkpoint, tokens, crc32 of the code lengths, bits
#: Pieces, and bytes of them and their ids, that a worker remembers at most; beyond it, it keeps those that came back, half as many at most. Longer pieces than LONG bytes are not remembered.
MEMORY, MEMORY_BYTES, LONG = 800_000, 40_000_000, 256
#: Bytes of text whose pieces are looked up in one step, about, and of those that are cut at once, or one text.
STEP, CUT = 24_000_000, 1_000_000
#: Pieces whose ids are gathered at once, and new ones that the library gets in one text.
GATHER, RUN = 200_000, 256

# Classes of bytes: letters, digits, marks and the apostrophe of ASCII; space; other white space of ASCII; what a splitter may see in another way; bytes of other characters.
_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _BREAK, _ODD, _OTHER = range(1, 9)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[:33], _CLASS[127] = _ODD, _ODD
_CLASS[33:127] = [_LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK for c in range(33, 127)]
_CLASS[ord("'")], _CLASS[32], _CLASS[9:14] = _QUOTE, _SPACE, _BREAK
_IS_SPACE = np.isin(np.arange(9), (_SPACE, _BREAK))
_MAY_BE_SPACE = _IS_SPACE | (np.arange(9) == _ODD)
_KIND = np.array([0, 1, 2, 3, 3, 0, 0, 0, 0], np.uint8)
#: The same as tables of bytes.translate, which takes a third of an index's time.
_TO_CLASS, _TO_KIND, _TO_SPACE, _TO_MAYBE = (np.resize(x, 256).astype(np.uint8).tobytes() for x in (_CLASS, _KIND, _IS_SPACE, _MAY_BE_SPACE))
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _translated(data: np.ndarray, table: bytes, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), kind)


def cuts(data: np.ndarray, starts: np.ndarray, whole: re.Pattern | None = None) -> np.ndarray:
    """Places in UTF-8 bytes, in order, where a byte-level splitter always ends a match: each text's start, changes between ASCII letters, digits and marks (but
    not from an apostrophe to a letter), and, in white space, before a run, before its last character, and after that unless it is a space, which goes with what follows.
    What `whole` matches stays whole, and so does white space before it."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    c = np.empty(n + 1, np.uint8)
    c[:n], c[n] = _translated(data, _TO_CLASS), _ODD
    for odd in (_WIDE_SPACE, whole) if whole else (_WIDE_SPACE,):
        for m in odd.finditer(data):
            c[m.start() : m.end()] = _ODD
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    kind, space, maybe = _translated(c, _TO_KIND), _translated(c, _TO_SPACE, np.bool_), _translated(c, _TO_MAYBE, np.bool_)
    before, now = c[: n - 1], c[1:n]
    cut = (kind[: n - 1] != kind[1:n]) & (kind[: n - 1] > 0) & (kind[1:n] > 0) & ~((before == _QUOTE) & (now == _LETTER))
    cut |= space[1:n] & (~maybe[: n - 1] | (~maybe[2:] & ~first[2:]))
    cut |= (before == _BREAK) & ~maybe[1:n]
    first[1:n] |= cut
    first[0] = True
    return np.flatnonzero(first[:n])


@dataclass(frozen=True)
class Settings:
    """longest: bits of a code at most. block: tokens of a block, or one longer document. checkpoint: tokens between noted bit offsets."""

    longest: int = 20
    block: int = 65_536
    checkpoint: int = 128
    end_id: int = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library.

    Texts are cut where the library's splitter always cuts, equal pieces are found by Arrow's dictionary encoding and looked up among those that are remembered,
    the library encodes each piece that is new, and ids are gathered. A step looks up its distinct pieces at once, and what is remembered is bounded in pieces and bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores; the library's own threads would only wait for work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        added = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.line_break = self._encoded(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        self.pieces = pa.array([], pa.binary())  # by number; an empty one stands for a long one, which is not remembered
        self.size, self.ids = np.zeros(0, np.int32), np.zeros(0, self.kind)  # by number: how many ids; all ids in order
        self.uses = np.zeros(0, np.int32)  # by number: steps in which it stood

    @property
    def known(self) -> list[bytes]:
        """The pieces that are remembered."""
        return [p for p in self.pieces.to_pylist() if p]

    @property
    def bytes(self) -> int:
        return self.pieces.nbytes + self.ids.nbytes

    def _thin(self) -> None:
        """Forgets the pieces that never came back, and of the others the least used beyond half the memory."""
        often = np.sort(self.uses[self.uses > 1])[::-1]
        least = max(2, int(often[MEMORY // 2])) if len(often) > MEMORY // 2 else 2
        stays = self.uses >= 2 if least == 2 else self.uses > least
        at = np.flatnonzero(stays & (pc.binary_length(self.pieces).to_numpy() > 0))[: MEMORY // 2]
        pieces, uses, size, first = self.pieces.take(pa.array(at)), self.uses[at] // 2, self.size[at], self._first()[at]
        ids = self._gathered(first, size)
        self.forget()
        self._keep(pieces, ids, size)
        self.uses = uses
        if self.bytes > MEMORY_BYTES // 2:
            self.forget()

    def _first(self) -> np.ndarray:
        """By number of a piece, the place of its first id."""
        return np.cumsum(self.size, dtype=np.int32) - self.size

    def _gathered(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of pieces one after the other: `size` of them from place `first` on."""
        end = np.cumsum(size, dtype=np.int32)
        return self.ids[np.repeat(first - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0, dtype=np.int32)]

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: pa.BinaryArray, ids: np.ndarray, size: np.ndarray) -> None:
        short = pc.if_else(pc.less_equal(pc.binary_length(pieces), LONG), pieces, pa.scalar(b"", pa.binary()))
        self.pieces = pa.concat_arrays([self.pieces, short])
        self.size, self.ids = np.concatenate([self.size, size.astype(np.int32)]), np.concatenate([self.ids, ids.astype(self.kind)])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int32)])

    def _learn(self, fresh: pa.BinaryArray) -> np.ndarray:
        """Encodes new pieces and gives their numbers: those of one word in runs with line breaks between them, which costs the library less than one call a word."""
        _, offsets, body = fresh.buffers()
        ends = np.frombuffer(offsets, np.int32)[fresh.offset : fresh.offset + len(fresh) + 1].astype(np.int64)
        data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]]
        start, size = ends[:-1] - ends[0], np.diff(ends)
        blank = _MAY_BE_SPACE[_CLASS[data]]
        blank[start[data[start] == 32]] = False
        for odd in (_WIDE_SPACE, self.added) if self.added else (_WIDE_SPACE,):
            for m in odd.finditer(data):
                blank[m.start() : m.end()] = True
        plain = (np.add.reduceat(blank, start, dtype=np.int64) == 0) & (size > (data[start] == 32)) & (size < 64)
        pieces = fresh.to_pylist()
        rest, runs = np.flatnonzero(~plain).tolist(), list(chunks(np.flatnonzero(plain).tolist(), RUN))
        order: list[int] = []
        found, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for some in chunks(runs, 16):
            for run, own in zip(some, self._encoded([b"\n".join([pieces[k] for k in run]).decode() for run in some]), strict=True):
                ids = np.array(own, np.int64)
                cut = np.flatnonzero(ids == self.line_break[0])
                if len(self.line_break) == 1 and len(cut) == len(run) - 1:
                    order += run
                    found.append(np.delete(ids, cut))
                    sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
                else:
                    rest += run
        for group in chunks(rest, RUN):
            own = self._encoded([pieces[k].decode() for k in group])
            order += group
            found += [np.array(ids, np.int64) for ids in own]
            sizes.append(np.array([len(ids) for ids in own], np.int64))
        number = np.empty(len(fresh), np.int32)
        number[order] = np.arange(len(self.size), len(self.size) + len(fresh), dtype=np.int32)
        self._keep(fresh.take(pa.array(order, pa.int64())), np.concatenate(found), np.concatenate(sizes))
        return number

    def numbers(self, pieces: pa.BinaryArray) -> np.ndarray:
        """Numbers of distinct pieces, which are learnt first if they are new."""
        found = pc.index_in(pieces, value_set=self.pieces)
        new = found.is_null()
        number = found.fill_null(0).to_numpy().copy()
        if found.null_count:
            number[np.flatnonzero(new.to_numpy(zero_copy_only=False))] = self._learn(pieces.filter(new))
        return number

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end); a null text has none."""
        if len(self.pieces) > MEMORY or self.bytes > MEMORY_BYTES:
            self._thin()
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends -= ends[0]
        if not len(body):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        cut = []
        for first, rows in byte_slices(texts, CUT):
            own = ends[first : first + len(rows) + 1]
            cut.append((cuts(body[own[0] : own[-1]], own[:-1] - own[0], self.added) + own[0]).astype(np.int32))
        cut = np.concatenate(cut)
        places = np.append(cut, np.int32(len(body)))
        pieces = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(places), pa.py_buffer(body)]).dictionary_encode()
        number = self.numbers(pieces.dictionary)
        self.uses[number] += 1
        which = pieces.indices.to_numpy()
        first, size = self._first()[number], self.size[number]
        ends_of = np.zeros(len(cut) + 1, np.int32)
        np.cumsum(size[which], out=ends_of[1:])
        out = np.empty(int(ends_of[-1]), self.kind)
        for at in range(0, len(which), GATHER):
            some = which[at : at + GATHER]
            out[ends_of[at] : ends_of[at + len(some)]] = self._gathered(first[some], size[some])
        return out, ends_of[np.searchsorted(cut, ends[1:].astype(np.int32))].astype(np.int64)


_encoders: dict[str, Encoder] = {}


def token_blocks(docs: DataFrame, tokenizer: str, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Blocks of whole documents' ids in order of document: (part, block, start, n, doc_ids, sizes, ids), start counted within its part.

    Parts are ranges of ids (rows with a null id first, equal ids by the text's hash), so they follow one another.
    """
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        part = TaskContext.get().partitionId()
        width, end = encoder.kind.itemsize, np.array([s.end_id], encoder.kind).tobytes()
        start = number = count = 0
        kind = None
        ids: list = []
        bodies: list[bytes] = []

        def block() -> pa.RecordBatch:
            sizes = [len(x) // width for x in bodies]
            one = [[part], [number], [start], [count]]
            arrays = [*(pa.array(x, pa.int64()) for x in one), pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(bodies)], pa.binary()), pa.array([width], pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "block", "start", "n", "doc_ids", "sizes", "ids", "width"])

        for b in batches:
            kind = b.column(0).type
            names = b.column(0).to_pylist()
            for first, rows in byte_slices(b.column(1), STEP):
                found, ends = encoder.encode(rows)
                at = 0
                for k, to in enumerate(ends.tolist()):
                    ids.append(names[first + k])
                    bodies.append(found[at:to].tobytes() + end)
                    at = to
                    count += len(bodies[-1]) // width
                    if count >= s.block:
                        yield block()
                        start, number, count, ids, bodies = start + count, number + 1, 0, [], []
        if bodies:
            yield block()

    kind = dict(docs.dtypes)[id_col]
    return mapped(ordered, run, f"part long, block long, start long, n long, doc_ids array<{kind}>, sizes array<long>, ids binary, width int")


def raw_ids(body: bytes, width: int) -> np.ndarray:
    return np.frombuffer(body, "<u2" if width == 2 else "<u4")


def counts(blocks: DataFrame) -> dict[int, int]:
    """How often each id occurs in all blocks; as many rows as the vocabulary at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for body, width in zip(b.column("ids"), b.column("width").to_pylist(), strict=True):
                own = np.bincount(raw_ids(body.as_buffer(), width))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = mapped(blocks.select("ids", "width"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(rows["id"].tolist(), rows["n"].tolist(), strict=True))


def code_lengths(count: dict[int, int], longest: int) -> np.ndarray:
    """Bits of each id's code (0: none), the least total under the limit, by package-merge; equal counts rank by id."""
    if not count:
        return np.zeros(1, np.uint8)
    symbols = np.array(sorted(count, key=lambda i: (count[i], i)), np.int64)
    weight = np.array([count[int(i)] for i in symbols], np.int64)
    out = np.zeros(int(symbols.max()) + 1, np.uint8)
    n = len(symbols)
    if n == 1:
        out[symbols] = 1
        return out
    if n > 1 << longest:
        raise ValueError("more ids than codes of that length")
    leaf_flags, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        leaf_flags.append(order < n)
        merged = both[order]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    out[symbols] = bits
    return out


@dataclass(frozen=True)
class Codebook:
    """Canonical codes: shorter ones first, then by id. table: id and bits of the code that starts each run of `longest` bits."""

    lengths: np.ndarray
    codes: np.ndarray
    longest: int
    crc: int

    @classmethod
    def of(cls, lengths: np.ndarray) -> Codebook:
        symbols = np.flatnonzero(lengths)
        symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
        bits = lengths[symbols].astype(np.int64)
        longest = int(bits.max()) if len(bits) else 1
        share = np.int64(1) << (longest - bits)
        codes = np.zeros(len(lengths), np.uint64)
        codes[symbols] = ((np.cumsum(share) - share) >> (longest - bits)).astype(np.uint64)
        return cls(lengths, codes, longest, zlib.crc32(lengths.astype(np.uint8).tobytes()))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        symbols = np.flatnonzero(self.lengths)
        symbols = symbols[np.argsort(self.lengths[symbols], kind="stable")]
        runs = np.int64(1) << (self.longest - self.lengths[symbols].astype(np.int64))
        ids, bits = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, np.uint8)
        ids[: runs.sum()], bits[: runs.sum()] = np.repeat(symbols, runs), np.repeat(self.lengths[symbols], runs)
        return ids, bits


def pack(ids: np.ndarray, book: Codebook, checkpoint: int) -> bytes:
    """One block: header, bit offsets of every `checkpoint`-th id, then codes, highest bit first."""
    bits = book.lengths[ids].astype(np.int64)
    if not bits.all():
        raise ValueError("an id has no code")
    code = book.codes[ids]
    ends = np.cumsum(bits)
    at = ends - bits
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        index, room = at >> 6, 64 - (at & 63) - bits
        whole = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        head = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        words[index[head]] = np.bitwise_or.reduceat(whole, head)
        over = np.flatnonzero(room < 0)
        words[index[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    head = HEAD.pack(MAGIC, 1, book.longest, checkpoint, len(ids), book.crc, total)
    return head + at[::checkpoint].astype("<u4" if total < 1 << 32 else "<u8").tobytes() + words.astype(">u8").tobytes()[: (total + 7) // 8]


def unpack(blocks: list[bytes], book: Codebook, table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Ids of blocks: all runs between checkpoints of all blocks are read side by side, an id of each at a time."""
    lanes, ends, parts, shift, total = [], [], [], 0, 0
    sizes = []
    for body in blocks:
        magic, version, longest, checkpoint, n, crc, bits = HEAD.unpack_from(body)
        if (magic, version, longest, crc) != (MAGIC, 1, book.longest, book.crc):
            raise ValueError("not a block of this codebook")
        kind, marks = np.dtype("<u4" if bits < 1 << 32 else "<u8"), -(-n // checkpoint)
        offsets = np.frombuffer(body, kind, marks, HEAD.size).astype(np.int64)
        payload = body[HEAD.size + marks * kind.itemsize :]
        lanes.append(offsets + shift * 8)
        ends.append(np.minimum(checkpoint, n - np.arange(marks) * checkpoint))
        parts.append(payload)
        shift += len(payload)
        sizes.append(n)
        total += n
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    at, left = np.concatenate([*lanes, np.zeros(0, np.int64)]), np.concatenate([*ends, np.zeros(0, np.int64)])
    start = np.cumsum(left) - left
    out = np.empty(total, np.uint32)
    ids, width = table
    step, low, mask = 0, np.uint64(64 - book.longest), np.int64((1 << book.longest) - 1)
    live = np.arange(len(at))
    wide = np.lib.stride_tricks.sliding_window_view(data, 8) if len(data) >= 8 else None
    while len(live):
        byte = at >> 3
        window = wide[byte].reshape(-1, 8).view(">u8").ravel().astype(np.uint64)
        key = ((window << (at & 7).astype(np.uint64)) >> low).astype(np.int64) & mask
        out[start[live] + step] = ids[key]
        at = at + width[key]
        step += 1
        more = left[live] > step
        if not more.all():
            live, at = live[more], at[more]
    return np.split(out, np.cumsum(sizes)[:-1])


def write(docs: DataFrame, path: str, tokenizer: str | None = None, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs and writes `path`/blocks (part, block, start, n, doc_ids, sizes, body: a packed block) and `path`/codebook (lengths).

    Parquet holds the blocks, so Spark commits and reads them on any store; `start` counts ids of all documents before.
    A null text is an empty one; each document ends with s.end_id. Documents stand in order of id, null ids first, equal ids in order of their texts' hash; rows that
    repeat are written as often. A text longer than a block is a block. An empty table gives no blocks. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    blocks = written(token_blocks(docs, tokenizer or default_tokenizer(), s, id_col, text_col), "tokens")
    lengths = code_lengths(counts(blocks), s.longest)
    before, total = {}, 0
    for part, n in sorted(blocks.groupBy("part").agg(F.sum("n")).collect()):  # a row a part
        before[part], total = total, total + n
    shared = spark.sparkContext.broadcast((lengths, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, before = shared.value
        book = Codebook.of(lengths)
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                body = pack(raw_ids(row.column("ids")[0].as_buffer(), row.column("width")[0].as_py()), book, s.checkpoint)
                start = row.column("start")[0].as_py() + before[row.column("part")[0].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [row.column("part"), row.column("block"), pa.array([start], pa.int64()), row.column("n"), row.column("doc_ids"), row.column("sizes"), pa.array([body], pa.binary())],
                    ["part", "block", "start", "n", "doc_ids", "sizes", "body"],
                )

    kind = dict(docs.dtypes)[id_col]
    mapped(blocks, run, f"part long, block long, start long, n long, doc_ids array<{kind}>, sizes array<long>, body binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    discard(blocks)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in files that `write` made; with `digest`, ids_crc32 in place of ids."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]), np.uint8)
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    last, kind = ("ids_crc32 long", pa.int64()) if digest else ("ids array<long>", pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook.of(shared.value)
        table = book.table()
        for b in batches:
            for k in range(0, b.num_rows, 8):
                rows = b.slice(k, 8)
                decoded = unpack([x.as_py() for x in rows.column("body")], book, table)
                for i, ids in enumerate(decoded):
                    sizes = np.array(rows.column("sizes")[i].as_py(), np.int64)
                    first = rows.column("start")[i].as_py() + np.cumsum(sizes) - sizes
                    own = np.split(ids, np.cumsum(sizes)[:-1])
                    tail = [zlib.crc32(x.astype("<u4").tobytes()) for x in own] if digest else [x.tolist() for x in own]
                    yield pa.RecordBatch.from_arrays([rows.column("doc_ids")[i].values, pa.array(first), pa.array(sizes), pa.array(tail, kind)], ["doc_id", "start", "n_tokens", last.split()[0]])

    id_kind = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]
    return mapped(blocks.select("start", "doc_ids", "sizes", "body"), run, f"doc_id {id_kind}, start long, n_tokens long, {last}")


def op2_token_ids(docs: DataFrame) -> DataFrame:
    """The contract's digest of the files that `write`, which states all odd cases, makes of docs."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/kindred/token-files-{uuid.uuid4().hex}"
    write(docs, path)
    return read(spark, path, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")
