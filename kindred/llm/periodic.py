"""Periodic runs: lags are counted by heavy and light words, and only lags with enough matches are scanned for runs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import BATCH_CHARS, extended, mapped, slices, without

RUN = "struct<start:long,length:long,period:long>"


@dataclass(frozen=True)
class Settings:
    """A run is of `least` words and of `copies` periods at least."""

    least: int = 24
    copies: int = 3

    def matches(self, lag: np.ndarray) -> np.ndarray:
        """Consecutive matches of words `lag` apart that a run of that period has at least."""
        return np.maximum(self.least - lag, (self.copies - 1) * lag)


def heavy_from(n: np.ndarray) -> np.ndarray:
    """Occurrences beyond which a word of a text of n words is heavy: there pairs cost more than a Fourier transform."""
    return np.sqrt(n * np.log2(np.maximum(n, 2))).astype(np.int64) + 8


def correlation(positions: list[np.ndarray], n: int, lags: int) -> np.ndarray:
    """For lags 0 to `lags`, the pairs of equal words so far apart, over all words, each given by its positions in a text of n words.

    Powers of the indicators' transforms are summed and transformed back once. Each is padded beyond the largest lag, so nothing wraps around, and sums below 2^40 round to whole numbers exactly.
    """
    size = 1 << int(n + lags).bit_length()
    power = np.zeros(size // 2 + 1)
    for own in positions:
        mark = np.zeros(size)
        mark[own] = 1
        spectrum = np.fft.rfft(mark)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)


def lag_counts(words: np.ndarray, ends: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(counts, first): for text t, counts[first[t] + lag] are the pairs of equal words `lag` apart, for lags up to a `copies`-th of the text's words.

    words: word numbers of all texts, one after the other; ends: where each text ends. Light words' pairs are taken by rank distance: each word with the one d occurrences on, for all texts at once.
    """
    size = np.diff(ends, prepend=0)
    most = np.where(size >= s.least, size // s.copies, 0)
    first = np.cumsum(most + 1) - (most + 1)
    counts = np.zeros(int((most + 1).sum()), np.int64)
    text = np.repeat(np.arange(len(ends)), size)
    key = text * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    often = np.diff(np.append(start, len(order)))
    its_text = text[order[start]] if len(start) else np.zeros(0, np.int64)
    heavy = often > heavy_from(size)[its_text]
    for t in np.unique(its_text[heavy & (most[its_text] > 0)]):
        begin = ends[t] - size[t]
        own = [order[start[g] : start[g] + often[g]] - begin for g in np.flatnonzero(heavy & (its_text == t))]
        counts[first[t] : first[t] + most[t] + 1] += correlation(own, int(size[t]), int(most[t]))
    rank_left = np.repeat(start + often, often) - np.arange(len(order))  # occurrences of the word from here on
    live = np.flatnonzero(np.repeat(~heavy, often) & (rank_left > 1))
    d = 1
    while len(live):
        lag = order[live + d] - order[live]
        t = text[order[live]]
        near = lag <= most[t]
        counts += np.bincount(first[t[near]] + lag[near], minlength=len(counts))
        d += 1
        live = live[near & (rank_left[live] > d)]  # farther occurrences are farther words
    return counts, first


def islands(words: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """(start, length) of the longest stretches in which words `lag` apart are equal, with `need` such pairs at least.

    A stretch holds each `need`-th place at one place at least, and either the need // 2 places from there on or those up to it; only if some place has that is the text scanned.
    """
    same = words[lag:] == words[:-lag]
    at = np.flatnonzero(same[::need]) * need
    half = need // 2
    for ahead in {1, half // 2, half - 1} - {0, -1}:
        at = at[(at + ahead < len(same)) & same[np.minimum(at + ahead, len(same) - 1)] | (at >= ahead) & same[np.maximum(at - ahead, 0)]]
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= need
    return [(int(b), int(e - b) + lag) for b, e in zip(begin[long], end[long], strict=True)]


def runs_of(words: np.ndarray, counts: np.ndarray, s: Settings) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period. counts: its lag counts, which are used up.

    Lags go upward. A run of period p and length l is, at each multiple of p below l, the same stretch again with l - lag pairs: these are taken off, so a
    lag is scanned only if its other pairs may make a run, and a stretch that a divisor of its lag has found before is none.
    """
    found: dict[tuple[int, int], int] = {}
    need = s.matches(np.arange(len(counts)))
    lag = 0
    while True:
        ahead = np.flatnonzero(counts[lag + 1 :] >= need[lag + 1 :])
        if not len(ahead):
            break
        lag += 1 + int(ahead[0])
        for stretch in islands(words, lag, int(need[lag])):
            if stretch not in found:
                found[stretch] = lag
                times = np.arange(2 * lag, min(stretch[1], len(counts)), lag)
                counts[times] -= stretch[1] - times
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that stand in no run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; of equal ones the first, then that of the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """docs with four columns more: kd_words (how many), kd_runs (all runs, by start, then period), kd_strongest (the run of most periods) and kd_collapsed (the words that no run repeats, one space between).

    Words are runs of characters other than ASCII white space. A run is a longest stretch of words in which words `period` apart are equal, `period` is the smallest such number, and which has
    `least` words and `copies` periods at least. A null or empty text has no words and no runs, and an empty collapsed text; equal rows get equal results; an empty table gives no
    rows. Columns of docs pass through, but those of the names above are replaced. Each text is handled whole where it lies: nothing is shuffled.
    """
    more = f"kd_words long, kd_runs array<{RUN}>, kd_strongest {RUN}, kd_collapsed string"
    docs = without(docs, more)
    schema, at = extended(docs, more), docs.columns.index(next(c for c in docs.columns if c.lower() == text_col.lower()))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_row = lambda r: {"start": r[0], "length": r[1], "period": r[2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, texts in slices(b, at, BATCH_CHARS):
                words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]  # bytes split at ASCII white space
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
                number = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
                counts, first = lag_counts(number, ends, settings)
                need = settings.matches(np.arange(len(counts)) - np.repeat(first, np.diff(np.append(first, len(counts)))))
                hopeful = np.zeros(len(counts) + 1, np.int64)
                hopeful[1:] = np.cumsum(counts >= need)
                last = np.append(first[1:], len(counts))
                runs: list[list[tuple[int, int, int]]] = [[]] * len(texts)
                for t in np.flatnonzero(hopeful[last] > hopeful[first]):
                    runs[t] = runs_of(number[ends[t] - len(words[t]) : ends[t]], counts[first[t] : last[t]], settings)
                best = [strongest(r) for r in runs]
                new = [
                    pa.array(list(map(len, words)), pa.int64()),
                    pa.array([[as_row(x) for x in r] for r in runs], pa.list_(kind)),
                    pa.array([r and as_row(r) for r in best], kind),
                    pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*b.slice(begin, len(texts)).columns, *new], schema.names)

    return mapped(docs, run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with runs in about a tenth of the texts, as their ids' checksums say: h = crc32(decimal id), g = h / 10 rounded down, and where h ends in 0 and the text has n > 0 words, each
    word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8) rounded down. Words then stand one space apart. Other texts, and those of a null id, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # bound once, as elements of lists; else each word would split the text again
    of = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def filled(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)

        def from_a(a):
            tail = lambda p: F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
            return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), of(1 + F.floor((n - a) / (3 + g % 8)), tail)), " ")

        return F.when(n > 0, of(g % n, from_a)).otherwise(F.lit(""))

    return docs.select("doc_id", F.when(h % 10 == 0, of(words, filled)).otherwise(F.col("text")).alias("text"))


def op13_periodic(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period and exponent_milli of the run of most periods (null without runs); runs_sha256 and collapsed_sha256 of `find_runs` over `planted` texts."""
    found = find_runs(planted(docs))
    best = F.col("kd_strongest")
    lines = F.transform("kd_runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("kd_runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * kd_strongest.length div kd_strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kd_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
