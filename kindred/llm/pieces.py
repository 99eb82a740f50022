"""Piece lattices: count-only Viterbi over a unigram vocabulary, and sampled segmentations with lossless decoding."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, count, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import extended, fresh, mapped, mixed, slices, without

SPACE = "▁"
UNK_PENALTY = 10.0
#: Words and characters of them that a worker remembers at most; beyond it, it starts anew.
MEMORY, MEMORY_CHARS = 400_000, 16_000_000
#: The same for sampling: words, and edges of their lattices.
WORDS, EDGES = 600_000, 4_000_000
#: Longer words have their lattice built one by one; shorter ones can't leave the range of a double.
LONG = 48
GROWTH = 64.0


@dataclass(frozen=True)
class Vocabulary:
    """pieces and scores by id; normal: ids of pieces of text; byte_ids: id of each byte."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[int, ...]
    byte_ids: tuple[int, ...]


@cache
def vocabulary(path: str) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces = tuple(sp.id_to_piece(i) for i in range(n))
    normal = tuple(i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))
    return Vocabulary(pieces, tuple(sp.get_score(i) for i in range(n)), normal, tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Counts the pieces of a unigram tokenizer's best segmentation without making it.

    The text is read with each space as the space mark and one mark before it. Scores add up in double precision; among equal sums
    the longest last piece wins; a character without a piece of its own costs UNK_PENALTY more than the lowest score and
    counts its UTF-8 bytes (byte fallback). Pieces hold the mark in front only (or are runs of it) and no line break, so text falls apart
    before marks and around line breaks, and equal words need one pass; with whole-number scores that is exact at any length.
    """

    def __init__(self, vocab: Vocabulary):
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in vocab.pieces):
            raise ValueError("pieces must hold the space mark in front only, and no line break")
        if any(not float(s).is_integer() for s in vocab.scores):
            raise ValueError("scores must be whole numbers: sums are exact then")
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(vocab.pieces):
            if p not in self.automaton:
                self.automaton.add_word(p, (len(p), vocab.scores[i]))
        self.automaton.make_automaton()
        self.single = {p for p in vocab.pieces if len(p) == 1}
        self.unk = min(vocab.scores) - UNK_PENALTY
        self.known: dict[str, int] = {}
        self.chars = 0

    def words(self, words: list[str]) -> list[int]:
        """Piece counts of words, in one pass of the automaton over all of them."""
        joined = "\n".join(words)
        best, count = [0.0] * (len(joined) + 1), [0] * (len(joined) + 1)
        out: list[int] = []
        matches = self.automaton.iter(joined)
        end, (length, score) = next(matches, (len(joined), (0, 0.0)))
        single, unk = self.single, self.unk
        for i, c in enumerate(joined):
            if c == "\n":
                out.append(count[i])
                best[i + 1], count[i + 1] = 0.0, 0
                continue
            top, pieces = -math.inf, 0
            while end == i:  # longest first
                start = i + 1 - length
                if (s := best[start] + score) > top:
                    top, pieces = s, count[start] + 1
                end, (length, score) = next(matches, (len(joined), (0, 0.0)))
            if c not in single and (s := best[i] + unk) > top:
                top, pieces = s, count[i] + len(c.encode())
            best[i + 1], count[i + 1] = top, pieces
        out.append(count[len(joined)])
        return out

    @staticmethod
    def parts(text: str) -> tuple[list[str], int]:
        """(words, line breaks) of a text."""
        lines = text.split("\n")
        out: list[str] = []
        for i, line in enumerate(lines):
            if SPACE in line or "  " in line or line.startswith(" ") or line.endswith(" "):
                marked = ("" if i else SPACE) + line.replace(" ", SPACE)
                out += re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked)
            else:
                own = line.replace(" ", "\n" + SPACE).split("\n")
                if not i:
                    own[0] = SPACE + own[0]
                out += own
        return out, len(lines) - 1

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.parts(t) if t else ([], 0) for t in texts]
        need = {w for own, _ in split for w in own} - self.known.keys() - {""}
        if len(self.known) + len(need) > 2 * MEMORY or self.chars > MEMORY_CHARS:
            self.known, self.chars = {}, 0
            need = {w for own, _ in split for w in own} - {""}
        order = list(need)
        self.chars += sum(map(len, order))
        self.known.update(zip(order, self.words(order) if order else [], strict=True))
        self.known[""] = 0
        get = self.known.__getitem__
        return [sum(map(get, own)) + breaks for own, breaks in split]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with kd_tokens, the pieces of each text; null and empty texts have none. model: a SentencePiece file that workers can open.

    Long texts are counted whole, a word without spaces in one pass. Among equal sums the longest last piece wins. Rows that repeat get the same count, an empty table gives none. Columns
    of docs pass through, but one named kd_tokens is replaced.
    """
    model = model or default_model()
    docs = without(docs, "kd_tokens long")
    column, own = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(model) or _counters.setdefault(model, Counter(vocabulary(model)))
        for b in batches:
            out: list[int] = []
            for _, part in slices(b, column):
                out += counter.counts(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*own, "kd_tokens"])

    return mapped(docs, run, extended(docs, "kd_tokens long"))


def op8_token_counts(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens, the count of `count_tokens`, which states all odd cases."""
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", F.col("kd_tokens").alias("n_tokens"))


# ---- sampled segmentations


class Sampler:
    """Samples segmentations by forward filtering and backward sampling over the lattice of pieces.

    A path's chance is in proportion to the product of its pieces' weights, (place among the normal pieces + 1) ** -power, the power law of
    a vocabulary in order of frequency. Spaces stand for the space mark and no mark is put before a text, so the mark itself, like every character
    that no piece spells, becomes its UTF-8 bytes, and decoding gives back every text. Words (cut before spaces and around line breaks,
    which no piece crosses) keep their lattice: for each end of a piece, the pieces that end there with running sums of
    their chances as 32-bit numbers. What ends at a place depends only on what stands before it, so words that are learnt together share the places
    (nodes) of a common beginning. A draw is a hash of the row's seed, the word's place in the text, and the place in the word,
    so it depends neither on batches nor on other rows.
    """

    def __init__(self, vocab: Vocabulary, power: float):
        self.vocab, self.power = vocab, power
        self.automaton = ahocorasick.Automaton()
        self.size = len(vocab.pieces)
        #: by id: length, weight; the last one is for characters without a piece
        self.length, self.weight = np.ones(self.size + 1, np.int64), np.full(self.size + 1, (self.size + 1.0) ** -power)
        spelt = np.zeros(0x110000, bool)
        ids: dict[str, int] = {}
        for rank, i in enumerate(vocab.normal):
            text = vocab.pieces[i].replace(SPACE, " ")
            if text.lstrip(" ").find(" ") >= 0 or "\n" in text:
                raise ValueError("pieces must hold the space mark in front only, and no line break")
            self.automaton.add_word(text, i)
            ids[text] = i
            self.length[i], self.weight[i] = len(text), (rank + 1.0) ** -power
            if len(text) == 1:
                spelt[ord(text)] = True
        self.automaton.make_automaton()
        self.spelt = spelt
        self.arrays(ids)
        #: a path's pieces cover a word's characters, so a factor for each character changes no chance and keeps sums near 1
        self.weight *= GROWTH**self.length
        self.bytes = np.array(vocab.byte_ids, np.int64)
        self.forget()

    def arrays(self, ids: dict[str, int]) -> None:
        """The automaton as arrays, so that many words take a step at once. A state is the longest end of what was read that begins a piece."""
        states = {p: k for k, p in enumerate(sorted({t[:k] for t in ids for k in range(len(t) + 1)}, key=lambda p: (len(p), p)))}
        kinds = {c: k for k, c in enumerate(sorted({c for t in ids for c in t}), 1)}
        self.kinds = len(kinds) + 1
        self.kind = np.zeros(0x110000, np.int32)  # by character; 0 is in no piece
        self.kind[[ord(c) for c in kinds]] = list(kinds.values())
        fall, ends, many = [0], [[]], [0]  # by state: the next shorter one; pieces that end there, longest first
        for p, k in list(states.items())[1:]:
            fall.append(next(states[p[n:]] for n in range(1, len(p) + 1) if p[n:] in states))
            ends.append(([ids[p]] if p in ids else []) + ends[fall[k]])
            many.append(len(ends[k]))
        self.fall, self.many = np.array(fall, np.int32), np.array(many, np.int64)
        self.ends, self.at_ends = np.array([i for own in ends for i in own] + [self.size], np.int32), np.cumsum(self.many) - self.many
        links = sorted((states[p[:-1]] * self.kinds + kinds[p[-1]], k) for p, k in states.items() if p)
        self.links, self.linked = np.array([x for x, _ in links] + [1 << 62], np.int64), np.array([k for _, k in links] + [0], np.int32)

    def after(self, states: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out, left = np.zeros(len(states), np.int32), np.arange(len(states))
        while len(left):
            link = states.astype(np.int64) * self.kinds + kinds
            k = np.searchsorted(self.links, link)
            hit = self.links[k] == link
            out[left[hit]] = self.linked[k[hit]]
            more = np.flatnonzero(~hit & (states > 0))
            left, states, kinds = left[more], self.fall[states[more]], kinds[more]
        return out

    def forget(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)  # by word, in order of their first use
        self.last = array("i")  # by word's number: its last node
        self.nodes = 1  # node 0 stands before all words
        self.keys, self.starts, self.ids = array("q"), array("i"), array("i")  # by edge: running chance, node before, piece
        self.edge = array("i", [0])  # by node: its first edge

    def learn(self, words: list[str]) -> np.ndarray:
        """Forward filtering: sums over all paths to each place of different words in order, place after place for all words at once. Their last nodes."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        chars = np.zeros((int(sizes.max()) + 1, n), np.uint32)  # by place and word
        inside = np.arange(len(chars)) < sizes[:, None]
        chars.T[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        differ = chars[:, 1:] != chars[:, :-1]
        differ[sizes[:-1], np.arange(n - 1)] = True  # a word's end differs from a NUL
        shared = np.concatenate([[0], np.argmax(differ, axis=0)])  # characters in common with the word before
        at = np.zeros((len(chars), n), np.int32)  # by place and word: the node, from 0 for these words
        most = int((sizes - shared).sum()) + 1
        state, total = np.zeros(most, np.int32), np.ones(most)
        made = 1
        for d in range(len(chars) - 1):
            new = (shared <= d) & (sizes > d)
            own = np.flatnonzero(new)
            at[d + 1] = np.cumsum(new) + (made - 1)
            node, c = at[d + 1, own], chars[d, own]
            state[node] = s = self.after(state[at[d, own]], self.kind[c])
            bare = ~self.spelt[c]
            many = self.many[s] + bare
            tail = np.cumsum(many)
            head, tail = tail - many, tail - 1
            slot = np.arange(int(tail[-1]) + 1) + np.repeat(self.at_ends[s] - head, many)
            slot[tail[bare]] = len(self.ends) - 1
            piece, place = self.ends[slot], np.repeat(np.arange(len(own)), many)
            start = at[d + 1 - self.length[piece], own[place]]
            chance = total[start] * self.weight[piece]
            total[node] = whole = np.add.reduceat(chance, head)
            q = np.floor(chance / whole[place] * 4294967295.0).astype(np.int64)
            running = np.cumsum(q)
            running -= np.repeat((running - q)[head], many)
            running[tail] = 1 << 32
            piece[tail[bare]] = c[bare] + self.size
            self.edge.frombytes((head + len(self.ids)).astype(np.int32).tobytes())
            self.keys.frombytes(running.tobytes())
            self.starts.frombytes(np.where(start > 0, start + (self.nodes - 1), 0).astype(np.int32).tobytes())
            self.ids.frombytes(piece.tobytes())
            made += len(own)
        last = at[sizes, np.arange(n)] + (self.nodes - 1)
        self.nodes += made - 1
        return last

    def learn_long(self, word: str) -> int:
        """The same for one word of any length, whose sums are scaled on the way."""
        n = len(word)
        total = [1.0] + [0.0] * n
        base = self.nodes - 1  # and so many nodes to the one before the word's first
        matches = self.automaton.iter(word)
        end, piece = next(matches, (-1, 0))
        for i, c in enumerate(word):
            edges = []
            while end == i:
                k = int(self.length[piece])
                edges.append((total[i + 1 - k] * self.weight[piece], i + 1 - k, piece))
                end, piece = next(matches, (-1, 0))
            if not self.spelt[ord(c)]:
                edges.append((total[i] * self.weight[self.size], i, self.size + ord(c)))
            whole, running = sum(e[0] for e in edges), 0
            self.edge.append(len(self.ids))
            for p, start, code in edges[:-1]:
                running += int(p / whole * 4294967295.0)
                self.keys.append(running)
                self.starts.append(base + start if start else 0)
                self.ids.append(code)
            self.keys.append(1 << 32)
            self.starts.append(base + edges[-1][1] if edges[-1][1] else 0)
            self.ids.append(edges[-1][2])
            total[i + 1] = whole
            if not 1e-100 < whole < 1e100:  # chances are ratios of nearby sums, so all that later pieces can reach may be scaled
                for j in range(max(0, i - 64), i + 2):
                    total[j] /= whole
        self.nodes += n
        return base + n

    @staticmethod
    def parts(text: str) -> list[str]:
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            if line:
                out += re.findall(" +[^ ]*|[^ ]+", line) if "  " in line else [w for w in line.replace(" ", "\n ").split("\n") if w]
        return out

    def encode(self, texts: list[str | None], seeds: list[int]) -> list[np.ndarray]:
        """Ids of one sampled segmentation of each text."""
        if len(self.numbers) > WORDS or len(self.ids) > EDGES:
            self.forget()
        split = [self.parts(t) if t else [] for t in texts]
        counts = np.array([len(own) for own in split], np.int64)
        total = int(counts.sum())
        if not total:
            return [np.zeros(0, np.int64) for _ in texts]
        old, get = len(self.numbers), self.numbers.__getitem__
        word = np.fromiter(map(get, chain.from_iterable(split)), np.int64, total)
        new = list(islice(self.numbers, old, None))
        short = sorted(w for w in new if len(w) <= LONG)  # in order, for common beginnings
        last = np.zeros(len(new), np.int32)
        for k in range(0, len(short), 20_000):
            run = short[k : k + 20_000]
            last[np.fromiter(map(get, run), np.int64, len(run)) - old] = self.learn(run)
        for w in (w for w in new if len(w) > LONG):
            last[get(w) - old] = self.learn_long(w)
        self.last.frombytes(last.tobytes())
        keys, starts, ids, edges = (np.frombuffer(a, t) for a, t in ((self.keys, np.int64), (self.starts, np.int32), (self.ids, np.int32), (self.edge, np.int32)))
        node = np.frombuffer(self.last, np.int32)[word]
        row = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = mixed(np.array(seeds, np.int64).view(np.uint64)[row] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at, steps, found = np.arange(total), np.zeros(total, np.int64), []
        while len(at):  # all that are left have taken as many steps
            draw = (mixed(seed + np.uint64((len(found) + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)).astype(np.int64)
            edge = edges[node]
            more = np.flatnonzero(keys[edge] <= draw)
            while len(more):
                edge[more] += 1
                more = more[keys[edge[more]] <= draw[more]]
            found.append((at, ids[edge]))
            steps[at] += 1
            node = starts[edge]
            more = np.flatnonzero(node)
            at, node, seed = at[more], node[more], seed[more]
        del keys, starts, ids, edges  # arrays can't grow while they are looked at
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]), np.int64)
        for k, (at, piece) in enumerate(found):
            out[ends[at] - 1 - k] = piece
        cut = np.concatenate([[0], ends])[np.cumsum(counts)]
        if (other := out >= self.size).any():
            spelt = {int(c): np.array(list(chr(c - self.size).encode("utf-8", "surrogatepass"))) for c in np.unique(out[other])}
            width = np.ones(len(out), np.int64)
            width[other] = [len(spelt[int(c)]) for c in out[other]]
            ends = np.cumsum(width)
            long = np.empty(int(ends[-1]), np.int64)
            long[(ends - 1)[~other]] = out[~other]
            for c, b in spelt.items():
                where = np.flatnonzero(out == c)
                for k in range(len(b)):
                    long[ends[where] - len(b) + k] = self.bytes[b[k]]
            out, cut = long, np.concatenate([[0], ends])[cut]
        return np.split(out, cut[:-1])


@cache
def spellings(vocab: Vocabulary) -> list[bytes]:
    """What each id spells."""
    spelt = [p.replace(SPACE, " ").encode() for p in vocab.pieces]
    for b, i in enumerate(vocab.byte_ids):
        spelt[i] = bytes([b])
    return spelt


_samplers: dict[tuple[str, float], Sampler] = {}


def encode(docs: DataFrame, model: str | None = None, seed: int = 1, power: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kd_ids, a segmentation of each text sampled with the row's key and `seed`; a null text has null ids, an empty one none.

    Rows of equal key and text get equal ids, and so do null keys. A higher power keeps closer to frequent pieces. Long texts are encoded whole; memory grows with a step's text and the
    longest run without spaces. An empty table gives no rows. Columns of docs pass through, but one named kd_ids is replaced.
    """
    model = model or default_model()
    docs = without(docs, "kd_ids array<int>")
    key = fresh("kd_key", docs)
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)))
    column, own = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _samplers.get((model, power)) or _samplers.setdefault((model, power), Sampler(vocabulary(model), power))
        for b in batches:
            for start, part in slices(b, column, 1_500_000):
                ids = sampler.encode(part, b.column(key).slice(start, len(part)).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)), mask=pa.array([t is None for t in part]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(start, len(part)) for c in range(len(own))), values], [*own, "kd_ids"])
        sampler.forget()  # workers live on; what they remember would stand in later stages' way

    return mapped(keyed, run, extended(docs, "kd_ids array<int>"))


def _spell(spelt: list[bytes], ids: list[int]) -> str:
    return b"".join(map(spelt.__getitem__, ids)).decode("utf-8", "surrogatepass")


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "kd_ids") -> DataFrame:
    """encoded with kd_text, the texts that the ids spell; null ids give null. Ids outside the vocabulary fail the task. A column named kd_text is replaced."""
    model = model or default_model()
    encoded = without(encoded, "kd_text string")
    column, own = encoded.columns.index(ids_col), encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = spellings(vocabulary(model))
        for b in batches:
            for k in range(0, b.num_rows, 200):
                rows = b.slice(k, 200)
                texts = [None if ids is None else _spell(spelt, ids) for ids in rows.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*own, "kd_text"])

    return mapped(encoded, run, extended(encoded, "kd_text string"))


def digests(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "kd_ids", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_crc32, n_chars, lossless) of encoded rows, from their ids decoded again: unsigned crc32 of the ids as little-endian
    32-bit numbers, characters of the decoded text, and whether it is the text. A null text has no tokens and is lossless. keep_ids adds ids."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = spellings(vocabulary(model))
        for b in batches:
            rows = []
            for text, ids in zip(b.column(1), b.column(2), strict=True):
                if not ids.is_valid:
                    rows.append((0, 0, 0, not text.is_valid))
                    continue
                values = ids.values.to_numpy()
                back = _spell(spelt, values.tolist())
                rows.append((len(values), zlib.crc32(values.astype("<u4").tobytes()), len(back), back == text.as_py()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            made = [b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(made + [b.column(2)] * keep_ids, [id_col, "n_tokens", "ids_crc32", "n_chars", "lossless"] + ["ids"] * keep_ids)

    kind = dict(encoded.dtypes)[id_col]
    return mapped(encoded.select(id_col, text_col, ids_col), run, f"`{id_col}` {kind}, n_tokens long, ids_crc32 long, n_chars long, lossless boolean" + ", ids array<int>" * keep_ids)


def op9_sentencepiece(docs: DataFrame) -> DataFrame:
    """The `digests` of sampled segmentations of all texts; `encode` states all odd cases."""
    return digests(encode(docs.select("doc_id", "text")))
