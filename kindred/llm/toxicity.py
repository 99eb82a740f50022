"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import discard, extended, mapped, slices, without, written

_SPACED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GAPS = ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB))  # bigrams; skip-grams over one word


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the feature space. max_rows: bound of the labelled sample, taken by hash of the id. min_rows: features in fewer rows
    of the sample stay out, as they only tell rows apart. alpha, beta, l1, l2, epochs: FTRL's."""

    bits: int = 22
    max_rows: int = 20_000
    min_rows: int = 4
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 8
    threshold: float = 0.7


def features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, word pair and pair over one word of lower-cased texts, with repeats."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()
        hashes.extend(map(xxhash.xxh3_64_intdigest, words))
        counts[i] = len(words)
    row = np.repeat(np.arange(len(texts)), counts)
    h = np.array(hashes, np.uint64)
    rows, found = [row], [h]
    for gap, key in _GAPS:
        same = row[:-gap] == row[gap:]
        rows.append(row[:-gap][same])
        found.append(((h[:-gap] * _MIX) ^ (h[gap:] + np.uint64(key)))[same] * _MIX)
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_features(texts: list[str | None], bits: int) -> list[np.ndarray]:
    row, feature = features(texts, bits)
    both = np.unique((row << bits) | feature)
    return np.split(both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(1, len(texts))))


def fit(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of a model fitted to (distinct features, label) rows in their order; one feature of a row counts 1."""
    size = 1 << s.bits
    z, n = np.zeros(size), np.zeros(size)
    seen = np.zeros(size, np.int32)
    for at, _ in rows:
        seen[at] += 1
    rows = [(at[seen[at] >= s.min_rows], y) for at, y in rows]
    positive = sum(y for _, y in rows)
    bias = float(np.log((positive + 1) / (len(rows) - positive + 1)))
    bias_z = bias_n = 0.0
    start = bias

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for at, y in rows:
            zs, ns = z[at], n[at]
            w = weight(zs, ns)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            root = np.sqrt(ns + g * g)
            z[at] = zs + g - (root - np.sqrt(ns)) / s.alpha * w
            n[at] = ns + g * g
            bias_z, bias_n = bias_z + g, bias_n + g * g
            bias = start - bias_z * s.alpha / (s.beta + np.sqrt(bias_n)) / 4
    w = weight(z, n)
    at = np.flatnonzero(w)
    return at, w[at], bias


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3) == 1


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on a sample of at most s.max_rows labelled rows with crc32(id) mod 3 != 1; an id labelled both ways counts as toxic; null ids and labels are skipped.

    One task sees the sample's distinct features (a bounded number of rows); weights come back sparse. Without labelled rows every score is 0.5. Ids may be of any type.
    """
    kind = dict(docs.dtypes)[id_col]
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
    chosen = known.groupBy(F.col(id_col).alias("kd_id")).agg(F.max("toxic").cast("int").alias("kd_y")).orderBy(F.xxhash64("kd_id"), "kd_id").limit(s.max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(chosen), F.col("id") == F.col("kd_id")).select("id", "kd_y", "body")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in slices(b, 2):
                found = [x.astype(np.int32).tobytes() for x in distinct_features(part, s.bits)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), b.column(1).slice(start, len(part)), pa.array(found, pa.binary())], ["id", "y", "at"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(a, np.int32).astype(np.int64), y) for b in batches for y, a in zip(b.column("y").to_pylist(), b.column("at").to_pylist(), strict=True)]
        at, w, bias = fit(rows, s)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([bias, *w.tolist()], pa.float64())], ["at", "w"])

    sample = written(mapped(texts, hashed, f"id {kind}, y int, at binary"), "toxic-sample")
    model = mapped(sample.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "at").select("y", "at"), fitted, "at long, w double").toPandas()
    discard(sample)
    if model.empty:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    kept = model[model["at"] >= 0]
    return kept["at"].to_numpy(), kept["w"].to_numpy(), float(model.loc[model["at"] < 0, "w"].iloc[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kd_score, the chance that a text is toxic; null and empty texts get the bias alone.

    Long texts are read whole; a feature counts once a text, however often it stands there. Rows that repeat get the same score, an empty table gives none. Columns of
    docs pass through, but one named kd_score is replaced.
    """
    docs = without(docs, "kd_score double")
    at, w, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((at.astype(np.int64), w.astype(np.float64), bias))
    schema = extended(docs, "kd_score double")
    column = docs.columns.index(text_col)
    bits = s.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        weights = np.zeros(1 << bits, np.float32)
        weights[at] = w
        for b in batches:
            out = np.empty(b.num_rows)
            for start, part in slices(b, column):
                row, feature = features(part, bits)
                hit = weights[feature] != 0
                both = np.unique((row[hit] << bits) | feature[hit])
                total = np.bincount(both >> bits, weights[both & ((1 << bits) - 1)], len(part)) + bias
                out[start : start + len(part)] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "kd_score"])

    return mapped(docs, run, schema)


def op6_toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The contract's columns of `score`, which states all odd cases; one row a row of docs. A null id is not held out."""
    model = train(docs, labels, s)
    scored = score(docs.select("doc_id", "text"), model, s)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("kd_score").alias("score"), (F.col("kd_score") >= s.threshold).cast("int").alias("predicted"))


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
