"""Quality rules: base counts of a text, and a linear-chain CRF that labels lines as content or boilerplate."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import discard, extended, mapped, slices, without, written
from kindred.llm.toxicity import held_out

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
#: Upper edges of a measure's ranges; a line has one feature for the range of each measure.
EDGES = {
    "words": (1, 3, 6, 12, 25, 60),
    "symbols a word": (0, 0.05, 0.2, 0.5),
    "pipes a word": (0, 0.1, 0.3),
    "exclamation marks a word": (0, 0.1, 0.4),
    "upper-case letters a letter": (0.02, 0.1, 0.3, 0.8),
    "words repeated in the line": (0.2, 0.4, 0.6, 0.8),
    "characters a word": (3, 4, 5, 6, 8),
    "digits a character": (0, 0.05, 0.2),
    "link marks": (0,),
}
_FLAGS = 5  # ends a sentence; equals an earlier line; first line; last line; a line known to stand in many texts
_OFFSETS = np.cumsum([0, *(len(e) + 1 for e in EDGES.values())])
N_FEATURES = int(_OFFSETS[-1]) + _FLAGS
BOILERPLATE, CONTENT = 0, 1


@dataclass(frozen=True)
class Settings:
    """max_docs: bound of the labelled sample, by hash of the id. max_lines: lines of a text at most; longer ones are not learnt from, so the sample's lines are
    bounded too. contexts: different lines before a line that make it a common one. rounds: times that lines are labelled anew. min_share: words in content lines a word of the text, at least, to keep it."""

    max_docs: int = 6000
    max_lines: int = 512
    contexts: int = 5
    rounds: int = 2
    steps: int = 100
    rate: float = 0.15
    l2: float = 1e-3
    min_share: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) as the contract states them; a null text has none."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.strip(_SPACES))
        else:
            seen.add(line)
    repeat = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        base = len(ids)
        if base < 2_000_000:
            code = (a[:-2] * base + a[1:-1]) * base + a[2:]
        else:  # pairs first, so that codes of very long texts stay within 64 bits
            pair = np.unique(a[:-1] * base + a[1:], return_inverse=True)[1]
            code = pair[:-1] * base + a[2:]
        _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        often = count[inverse] > 1
        marked = np.zeros(n, bool)
        for k in range(3):
            marked[k : n - 2 + k] |= often
        repeat = int(marked.sum())
    return n, chars, symbols, dup, repeat


_UPPER, _ASCII = string.ascii_uppercase.encode(), re.compile(r"[\x00-\x7f]+")


def upper_letters(line: str) -> int:
    """Upper-case letters of the whole line; those of ASCII are counted as bytes, others one by one."""
    plain = line.encode("ascii", "ignore")
    n = len(plain) - len(plain.translate(None, _UPPER))
    return n if len(plain) == len(line) else n + sum(map(str.isupper, _ASCII.sub("", line)))


def line_hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines]


def line_features(lines: list[str], common: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line as 0 and 1, words of each line); common: hashes of lines that stand in many texts."""
    measures = np.zeros((len(lines), len(EDGES)))
    flags = np.zeros((len(lines), _FLAGS), np.uint8)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words) or 1
        size = len(line) or 1
        measures[i] = (
            len(words), sum(map(line.count, SYMBOLS)) / n, line.count("|") / n, line.count("!") / n, upper_letters(line) / size, 1 - len(set(words)) / n,
            (size - n + 1) / n, (sum(map(line.count, "0123456789")) if not line.isalpha() else 0) / size, line.count("http") + line.count("@"),
        )
        flags[i] = line.rstrip()[-1:] in (".", "?", "…"), line in seen, i == 0, i == len(lines) - 1, False
        seen.add(line)
    out = np.zeros((len(lines), N_FEATURES), np.uint8)
    rows = np.arange(len(lines))
    for k, edges in enumerate(EDGES.values()):
        out[rows, _OFFSETS[k] + np.searchsorted(edges, measures[:, k])] = 1
    out[:, _OFFSETS[-1] :] = flags
    if common:
        out[:, -1] = [h in common for h in line_hashes(lines)]
    return out, measures[:, 0].astype(np.int64)


@dataclass(frozen=True)
class Crf:
    """Weights: of a line's features for each label, of a label after a label, of the first label; hashes of common lines."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray
    common: frozenset[int] = frozenset()


EMPTY = Crf(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))


@dataclass(frozen=True)
class _Padded:
    """Texts of about one length side by side: features, which places are lines, and, flat over those, features alone."""

    at: list[int]
    real: np.ndarray
    flat: np.ndarray


def _batches(xs: list[np.ndarray], lines: int = 8192) -> list[_Padded]:
    """Whole texts in order of length, in batches of about so many places or one text."""
    out, order, k = [], sorted(range(len(xs)), key=lambda i: (len(xs[i]), i)), 0
    while k < len(order):
        end = k + 1
        while end < len(order) and (end + 1 - k) * len(xs[order[end]]) <= lines:
            end += 1
        own = order[k:end]
        size = np.array([len(xs[i]) for i in own])
        out.append(_Padded(own, np.arange(size.max())[None] < size[:, None], np.concatenate([xs[i] for i in own]).astype(np.float64)))
        k = end
    return out


def _sums(b: _Padded, theta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward sums: (chance of each label at each place, of each step summed over all, log of the sum over all paths of each text)."""
    emit, step, first = theta
    n, longest = b.real.shape
    e = np.zeros((n, longest, 2))
    e[b.real] = b.flat @ emit
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    fwd[:, 0] = e[:, 0] + first
    for t in range(1, longest):
        a = np.logaddexp(fwd[:, t - 1, 0, None] + step[0], fwd[:, t - 1, 1, None] + step[1]) + e[:, t]
        fwd[:, t] = np.where(b.real[:, t, None], a, fwd[:, t - 1])
    for t in range(longest - 2, -1, -1):
        ahead = bwd[:, t + 1] + e[:, t + 1]
        a = np.logaddexp(step[:, 0] + ahead[:, 0, None], step[:, 1] + ahead[:, 1, None])
        bwd[:, t] = np.where(b.real[:, t + 1, None], a, 0)
    total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    p = np.exp(fwd + bwd - total[:, None, None]) * b.real[..., None]
    pair = np.exp(fwd[:, :-1, :, None] + step + (e + bwd)[:, 1:, None, :] - total[:, None, None, None]) * b.real[:, 1:, None, None]
    return p, pair.sum((0, 1)), total


def gradient(batches: list[_Padded], ys: list[np.ndarray], theta: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """(log likelihood of the labels, its gradient with the sign turned)."""
    value, grads = 0.0, [np.zeros_like(t) for t in theta]
    for b in batches:
        y = np.zeros(b.real.shape, np.int64)
        y[b.real] = np.concatenate([ys[i] for i in b.at])
        gold = np.eye(2)[y] * b.real[..., None]
        p, pair, total = _sums(b, theta)
        steps = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
        grads[0] += b.flat.T @ (p - gold)[b.real]
        grads[1] += pair - steps
        grads[2] += (p - gold)[:, 0].sum(0)
        value += float(((b.flat @ theta[0]) * gold[b.real]).sum() + (steps * theta[1]).sum() + (gold[:, 0] * theta[2]).sum() - total.sum())
    return value, grads


def fit(runs: list[tuple[np.ndarray, np.ndarray]], s: Settings, start: Crf | None = None) -> Crf:
    """Maximum likelihood with a little L2 by Adam over all (features, labels) of whole texts."""
    batches, ys = _batches([x for x, _ in runs]), [y for _, y in runs]
    theta = [start.emit, start.step, start.first] if start else [np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for k in range(1, s.steps + 1):
        for i, g in enumerate(gradient(batches, ys, theta)[1]):
            g = g / len(runs) + s.l2 * theta[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            theta[i] = theta[i] - s.rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return Crf(*theta)


def relabelled(doubt: np.ndarray, words: np.ndarray, label: int, s: Settings) -> np.ndarray:
    """Labels of a text's lines: those of the text, but for lines that are doubted by more than a half, most doubted first, as far as the share of words in content
    lines stays on the side of s.min_share that the text's label demands."""
    y = np.full(len(words), label)
    for k in np.argsort(-doubt, kind="stable").tolist():
        if doubt[k] <= 0.5:
            break
        y[k] = 1 - label
        kept = words[y == CONTENT].sum() >= s.min_share * words.sum()
        if words[k] and kept != (label == CONTENT):
            y[k] = label
            break
    return y


def common_lines(texts: list[np.ndarray], s: Settings) -> frozenset[int]:
    """Hashes of lines that stand after s.contexts different lines or more; copies of a text repeat its lines in one context only."""
    pairs = [np.stack([np.concatenate([[np.uint64(0)], h[:-1]]), h], 1) for h in texts if len(h)]
    if not pairs:
        return frozenset()
    line, n = np.unique(np.unique(np.concatenate(pairs), axis=0)[:, 1], return_counts=True)
    return frozenset(line[n >= s.contexts].tolist())


def learn(texts: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], s: Settings) -> Crf:
    """A model from (features, words a line, hashes of lines, quality) of texts. No line's label is given; texts' are.

    Lines that are common start as boilerplate in texts of quality 1, all others with their text's label; then a model is fitted, and lines that
    it doubts change sides within `relabelled`, s.rounds times.
    """
    both = {y for *_, y in texts} >= {0, 1}
    common = common_lines([h for _, _, h, _ in texts], s)
    if not both:
        return EMPTY
    for x, _, h, _ in texts:
        x[:, -1] = np.isin(h, np.fromiter(common, np.uint64, len(common)))
    ys = [relabelled(x[:, -1] * float(y == CONTENT), words, y, s) for x, words, _, y in texts]
    xs, model = [x for x, *_ in texts], None
    for _ in range(s.rounds + 1):
        if model:
            for b in _batches(xs):
                p = _sums(b, [model.emit, model.step, model.first])[0]
                for row, i in enumerate(b.at):
                    _, words, _, y = texts[i]
                    ys[i] = relabelled(p[row, : len(words), 1 - y], words, y, s)
        model = fit(list(zip(xs, ys, strict=True)), s, model)
    return Crf(model.emit, model.step, model.first, common)


def viterbi(model: Crf, features: np.ndarray) -> np.ndarray:
    """The likeliest labels of a text's lines; a tie goes to content."""
    e = features @ model.emit
    (s00, s01), (s10, s11) = model.step.tolist()
    rows = e.tolist()
    a, b = rows[0][0] + model.first[0], rows[0][1] + model.first[1]
    back: list[tuple[int, int]] = []
    for x, y in rows[1:]:
        to0, to1 = int(b + s10 >= a + s00), int(b + s11 >= a + s01)
        a, b = (b + s10 if to0 else a + s00) + x, (b + s11 if to1 else a + s01) + y
        back.append((to0, to1))
    at = int(b >= a)
    out = [at]
    for step in reversed(back):
        at = step[at]
        out.append(at)
    return np.array(out[::-1])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """Learns from at most s.max_docs labelled texts with crc32(id) mod 3 != 1. An id labelled both ways counts as quality 0; null ids and labels are skipped.

    Without both kinds of labels the model has only zeros and marks every line as content. One task sees the sample's lines, a bounded number.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(id_col))
    chosen = known.groupBy(F.col(id_col).alias("kd_id")).agg(F.min("quality").cast("int").alias("kd_y")).orderBy(F.xxhash64("kd_id"), "kd_id").limit(s.max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(chosen), F.col("id") == F.col("kd_id")).select("id", "kd_y", "body")
    kind = dict(docs.dtypes)[id_col]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in slices(b, 2):
                rows = []
                for k, t in enumerate(part):
                    lines = (t or "").split("\n")
                    if len(lines) <= s.max_lines:
                        x, words = line_features(lines)
                        rows.append((start + k, np.packbits(x, axis=1).tobytes(), words.tolist(), np.array(line_hashes(lines), np.uint64).tobytes()))
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [pa.array([r[j] for r in rows], t) for j, t in ((1, pa.binary()), (2, pa.list_(pa.int64())), (3, pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *columns], ["id", "y", "x", "words", "hashes"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, texts = (N_FEATURES + 7) // 8, []
        for b in batches:
            for row in b.to_pylist():
                x = np.unpackbits(np.frombuffer(row["x"], np.uint8).reshape(-1, width), axis=1)[:, :N_FEATURES]
                texts.append((x, np.array(row["words"], np.int64), np.frombuffer(row["hashes"], np.uint64), row["y"]))
        model = learn(texts, s)
        numbers = [pa.array([t.ravel().tolist()], pa.list_(pa.float64())) for t in (model.emit, model.step, model.first)]
        common = pa.array([np.array(sorted(model.common), np.uint64).view(np.int64).tolist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*numbers, common], ["emit", "step", "first", "common"])

    sample = written(mapped(texts, seen, f"id {kind}, y int, x binary, words array<long>, hashes binary"), "quality-sample")
    one = sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "x").select("y", "x", "words", "hashes")
    row = mapped(one, fitted, "emit array<double>, step array<double>, first array<double>, common array<long>").first()
    discard(sample)
    if row is None:
        return EMPTY
    common = frozenset(np.array(row["common"], np.int64).view(np.uint64).tolist())
    return Crf(np.array(row["emit"]).reshape(-1, 2), np.array(row["step"]).reshape(2, 2), np.array(row["first"]), common)


def judge(docs: DataFrame, model: Crf, s: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """docs with kd_words, kd_word_chars, kd_symbols, kd_dup_lines, kd_repeat_words, kd_failed, kd_share, kd_kept and kd_labels (a 1 or 0 for each line).

    A null or empty text has no words, fails the base rules and is not kept; it is one line. A long text is read whole, and so are its lines. Rows that repeat get the same
    result; a tie of two label sequences goes to content. An empty table gives no rows. Columns of docs pass through, but those with names of the added
    ones are replaced by them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["kd_words", "kd_word_chars", "kd_symbols", "kd_dup_lines", "kd_repeat_words"]
    more = ", ".join(f"{n} long" for n in names) + ", kd_failed boolean, kd_share double, kd_kept boolean, kd_labels string"
    docs = without(docs, more)
    column, own = docs.columns.index(text_col), docs.columns
    schema = extended(docs, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for start, part in slices(b, column):
                rows = []
                for text in part:
                    counts = base_counts(text)
                    failed = counts[0] < s.min_words or 100 * counts[4] > s.max_repeat_percent * counts[0]
                    x, words = line_features((text or "").split("\n"), model.common)
                    labels = viterbi(model, x)
                    share = float(words[labels == CONTENT].sum() / words.sum()) if words.sum() else 0.0
                    rows.append((*counts, failed, share, not failed and share >= s.min_share, "".join(map(str, labels.tolist()))))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, len(part)) for c in b.columns), *columns], [*own, *names, "kd_failed", "kd_share", "kd_kept", "kd_labels"])

    return mapped(docs, run, schema)


def op4_quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The contract's columns of `judge`, which states all odd cases, with a model of `train`; and content_share."""
    judged = judge(docs.select("doc_id", "text"), train(docs, labels, s), s)
    return judged.select(
        "doc_id", F.col("kd_words").alias("n_words"), F.col("kd_word_chars").alias("word_chars"), F.col("kd_symbols").alias("n_symbols"), F.col("kd_dup_lines").alias("n_dup_lines"),
        F.col("kd_repeat_words").alias("n_repeat_words"), F.col("kd_failed").alias("base_failed"), F.col("kd_kept").alias("kept"), F.col("kd_share").alias("content_share"),
    )
