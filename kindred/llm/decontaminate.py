"""Benchmark decontamination: greedy string tiling of documents against benchmark items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from kindred.llm.common import extended, fresh, mapped, slices

_BASE = 0x9E3779B97F4A7C15
_SPACED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """tile: fewest words of a tile. seed: words of a seed, by which documents meet items (at most tile). percent: covered words of an item that convict.

    Items with fewer words than a tile must stand in a document whole. block_chars: items go out in blocks of about so many characters, so a
    block's broadcast is bounded however long the benchmark is.
    """

    tile: int = 5
    seed: int = 5
    percent: int = 50
    block_chars: int = 16_000_000


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each text): runs of letters and digits, lower-cased."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()
        hashes.extend(map(xxhash.xxh3_64_intdigest, words))
        counts[i] = len(words)
    return np.array(hashes, np.uint64), counts


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k words: one from the other by a product and a sum, modulo 2 ** 64."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = np.uint64(_BASE | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate([one, np.full(len(h) - 1, base)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([one, np.full(len(h) - k, inverse)]), dtype=np.uint64)
    sums = np.concatenate([one - one, np.cumsum(h * power, dtype=np.uint64)])
    return (sums[k:] - sums[:-k]) * back


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (place in doc, place in item, length) of the longest matches of words marked by none before.

    The search length starts at the longest common run (found by doubling and halving) and falls to `least`; at each length all unmarked
    runs meet by hash and are confirmed word by word; ties go to the first place in the item, then in the document.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []

    def starts(free: np.ndarray, k: int) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(free)])
        return np.flatnonzero(c[k:] - c[:-k] == k) if len(free) >= k else np.zeros(0, np.int64)

    def meets(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = starts(free_i, k), starts(free_d, k)
        if not len(a) or not len(b):
            return a[:0], b[:0], np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hi, hd = rolling(item, k)[a], rolling(doc, k)[b]
        order = np.argsort(hd, kind="stable")
        hd, b = hd[order], b[order]
        at = np.searchsorted(hd, hi)
        ok = (at < len(hd)) & (hd[np.minimum(at, len(hd) - 1)] == hi)
        return a[ok], b, at[ok], hd

    def longest(high: int) -> int:
        low = least - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(meets(mid)[0]) else (low, mid - 1)
        return low

    k = longest(min(len(doc), len(item)))
    while k >= least:
        a, b, at, hd = meets(k)
        for i, p in zip(a.tolist(), at.tolist(), strict=True):
            if not free_i[i : i + k].all():
                continue
            same = hd[p]
            while p < len(hd) and hd[p] == same:
                d = int(b[p])
                if free_d[d : d + k].all() and (doc[d : d + k] == item[i : i + k]).all():
                    free_d[d : d + k] = False
                    free_i[i : i + k] = False
                    out.append((d, i, k))
                    break
                p += 1
        k = longest(k - 1)
    return out


def reach(doc: np.ndarray, item: np.ndarray, k: int) -> int:
    """Words of the item in runs of k words that the document holds too: tiles of k words or more cover no others."""
    held = np.isin(rolling(item, k), rolling(doc, k))
    covered = np.zeros(len(item), bool)
    for j in range(k):
        covered[j : len(item) - k + 1 + j] |= held
    return int(covered.sum())


def blocks(benchmark: DataFrame, s: Settings, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark's (item, text) rows in blocks of bounded size, streamed to the driver a partition at a time."""
    block, size = [], 0
    for row in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).orderBy(item_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= s.block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def rare_seeds(seeds: list[np.ndarray], words: list[int], k: int, percent: int) -> list[np.ndarray]:
    """Of each item's seeds (hashes of its runs of k words) those that must meet: a document that covers `percent` percent of the words holds so many
    seeds that it misses at most those left over, so all but the most frequent of them, one fewer than it must hold, suffice."""
    names, where, often = np.unique(np.concatenate(seeds), return_inverse=True, return_counts=True)
    out, at = [], 0
    for own, n in zip(seeds, words, strict=True):
        count = often[where[at : at + len(own)]]
        at += len(own)
        must = -(-(-(-percent * n // 100)) // k)
        out.append(own[np.argsort(count, kind="stable")][: max(1, len(own) - max(0, must - 1))])
    return out


def _against(docs: DataFrame, block: list[tuple], kind: str, s: Settings, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(row's id and mark, item, covered, words, spans) of document and item pairs that share a tile; with `percent`, only pairs that may reach it are tiled, and others may be missing."""
    hashes, counts = words_of([t for _, t in block])
    items = [(name, x) for (name, _), x in zip(block, np.split(hashes, np.cumsum(counts)[:-1]), strict=True) if len(x)]
    # seeds: all runs of s.seed words of an item; of an item of fewer words, all of it, by its length
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in sorted({min(s.seed, len(x)) for _, x in items}):
        own = [(j, rolling(x, k)) for j, (_, x) in enumerate(items) if min(s.seed, len(x)) == k]
        if percent:
            own = list(zip([j for j, _ in own], rare_seeds([r for _, r in own], [len(items[j][1]) for j, _ in own], k, percent), strict=True))
        keys, who = np.concatenate([r for _, r in own]), np.concatenate([np.full(len(r), j) for j, r in own])
        order = np.argsort(keys, kind="stable")
        by_length[k] = keys[order], who[order]
    shared = docs.sparkSession.sparkContext.broadcast((items, by_length))
    schema = StructType.fromDDL(f"id {dict(docs.dtypes)[id_col]}, mark long, item {kind}, covered long, words long, spans array<struct<doc:long,item:long,length:long>>")
    item_type = to_arrow_type(schema["item"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, by_length = shared.value
        bits = 20
        filters = {}
        for k, (keys, _) in by_length.items():
            filters[k] = np.zeros(1 << bits, bool)
            filters[k][(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        for b in batches:
            ids, marks = b.column(0), b.column(2)
            for start, part in slices(b, 1):
                h, counts = words_of(part)
                ends = np.cumsum(counts)
                meet: set[tuple[int, int]] = set()
                for k, (keys, who) in by_length.items():
                    r = rolling(h, k)
                    r_at = np.flatnonzero(filters[k][(r >> np.uint64(64 - bits)).astype(np.int64)])
                    lo = np.searchsorted(keys, r[r_at])
                    hit = (lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == r[r_at])
                    lo, r_at = lo[hit], r_at[hit]
                    hi = np.searchsorted(keys, r[r_at], "right")
                    row = np.searchsorted(ends, r_at, "right")
                    inside = r_at + k <= ends[row]
                    for x, a, z in zip(row[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), strict=True):
                        meet.update((x, int(j)) for j in who[a:z])
                out: list[tuple] = []
                for x, j in sorted(meet):
                    (name, item), doc = items[j], h[ends[x] - counts[x] : ends[x]]
                    if percent and 100 * reach(doc, item, min(s.seed, len(item))) < percent * len(item):
                        continue
                    found = tiles(doc, item, min(s.tile, len(item)))
                    covered = sum(t[2] for t in found)
                    if covered:
                        out.append((ids[start + x].as_py(), marks[start + x].as_py(), name, covered, len(item), [{"doc": d, "item": i, "length": n} for d, i, n in found]))
                if out:
                    spans = pa.list_(pa.struct([("doc", pa.int64()), ("item", pa.int64()), ("length", pa.int64())]))
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], ids.type), pa.array(c[1], pa.int64()), pa.array(c[2], item_type), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5], spans)], schema.names
                    )

    return mapped(docs.select(id_col, text_col, _mark(F.col(id_col), F.col(text_col))), run, schema)


def _mark(own: Column, text: Column) -> Column:
    """What tells rows with a null id apart: a hash of the text; null where there is an id."""
    return F.when(own.isNull(), F.xxhash64(text)).alias("mark")


def tilings(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", percent: int = 0) -> DataFrame:
    """(id, mark, item, covered, words, spans) for each document and item with a common tile: words of the item that tiles cover, and the tiles. mark: a hash of the text where the id is null, else null.

    Documents are read once a block of items; nothing is shuffled. Null texts and texts without words match nothing; so do items without words. Items with a null id match by their texts like others, and stand under a null item. Long texts are tiled whole; ties go to
    the first place; rows and items that repeat give a row each; empty tables give none. Columns other than those named are not read. With `percent`, pairs that can't cover so
    much of the item are left out early: by the item's rarer seeds, so that a phrase of many items brings few together, then by the words that common runs reach.
    """
    kind = dict(benchmark.dtypes)[item_col]
    out = None
    for block in blocks(benchmark, s, item_col, text_col):
        found = _against(docs, block, kind, s, id_col, text_col, percent)
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = docs.sparkSession.createDataFrame([], extended(docs.select(F.col(id_col).alias("id")), f"mark long, item {kind}, covered long, words long, spans array<struct<doc:long,item:long,length:long>>"))
        return empty
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, mark, item, covered, words, items) of documents that hold s.percent percent of an item's words or more: the item of largest share, then of least id, and how many there are (those with a null id, which comes first, count as one).
    Rows of one id are one document; each text of a null id is one, told by its mark."""
    found = tilings(docs, benchmark, s, id_col, text_col, item_col, s.percent).where(100 * F.col("covered") >= s.percent * F.col("words"))
    best = F.min(F.struct((-F.col("covered") / F.col("words")).alias("o"), "item", "covered", "words"))
    return found.groupBy("id", "mark").agg(best.alias("b"), (F.countDistinct("item") + F.max(F.col("item").isNull().cast("long"))).alias("items")).select("id", "mark", "b.item", "b.covered", "b.words", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that `contaminated` names: all rows of such an id go, and rows with a null id by their own text."""
    name, mark = fresh("kd_gone", docs), fresh("kd_mark", docs)
    gone = contaminated(docs, benchmark, s, id_col, text_col).select(F.col("id").alias(name), F.col("mark").alias(mark))
    return docs.join(gone, docs[id_col].eqNullSafe(gone[name]) & _mark(docs[id_col], docs[text_col]).eqNullSafe(gone[mark]), "left_anti")


def op10_decontaminate(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row a document: the item it holds most of (null if none), the words covered and in all, whether it is contaminated, and whether it stays."""
    bad = contaminated(docs, benchmark, s).withColumnsRenamed({"id": "kd_id", "mark": "kd_mark"})
    both = docs.select("doc_id", _mark(F.col("doc_id"), F.col("text"))).join(bad, F.col("doc_id").eqNullSafe(F.col("kd_id")) & F.col("mark").eqNullSafe(F.col("kd_mark")), "left")
    return both.select(
        "doc_id", F.col("item").alias("item_id"), F.coalesce("covered", F.lit(0)).cast("long").alias("covered_words"), F.coalesce("words", F.lit(0)).cast("long").alias("item_words"),
        F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), F.col("items").isNotNull().alias("contaminated"), F.col("items").isNull().alias("kept"),
    )
