"""Sharding: a Feistel permutation of global row numbers, with cycle walking; shard and slot follow from a row's number alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import discard, fresh, ship, without, written

#: The multipliers of MurmurHash3's 32-bit finisher, and 2^32 divided by the golden ratio, the step between round keys.
FIRST, SECOND, STEP = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B9
WORD = 0xFFFFFFFF


def _mixed(x: np.ndarray) -> np.ndarray:
    """32-bit words, in 64-bit ones, mixed so that each bit depends on all."""
    x = (x ^ (x >> np.uint64(16))) * np.uint64(FIRST) & np.uint64(WORD)
    x = (x ^ (x >> np.uint64(13))) * np.uint64(SECOND) & np.uint64(WORD)
    return x ^ (x >> np.uint64(16))


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 to n - 1 that hangs on (n, seed, rounds) alone and can be computed, either way, for any number by itself; n up to 2^62.

    A Feistel network permutes 0 to 4^half - 1, less than four times n or 4; what lands at n or above goes through it again, until it lands below.
    That walks along a cycle which starts below n, so it ends, and different starts end at different places.
    """

    n: int
    seed: int = 0
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 0).bit_length() + 1) // 2)

    @property
    def keys(self) -> list[int]:
        return [(self.seed + (k + 1) * STEP) & WORD for k in range(self.rounds)]

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & low
        for key in map(np.uint64, reversed(self.keys) if back else self.keys):
            if back:
                left, right = right ^ (_mixed((left + key) & np.uint64(WORD)) & low), left
            else:
                left, right = right, left ^ (_mixed((right + key) & np.uint64(WORD)) & low)
        return left << half | right

    def _walked(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = np.asarray(x).astype(np.uint64)
        at = np.arange(len(out))
        while len(at):
            out[at] = self._network(out[at], back)
            at = at[out[at] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Positions of row numbers below n."""
        return self._walked(rows, False)

    def row(self, places: np.ndarray) -> np.ndarray:
        """Row numbers at positions below n."""
        return self._walked(places, True)

    def column(self, spark: SparkSession, rows: Column) -> Column:
        """Positions of a column of row numbers."""
        ship(spark)

        @F.pandas_udf("long")
        def place(x: pd.Series) -> pd.Series:
            return pd.Series(self.place(x.to_numpy()))

        return place(rows)


def numbered(df: DataFrame, by: list[str], name: str = "kd_row") -> tuple[DataFrame, int]:
    """(df with its global row numbers from 0 in the order of `by`, how many there are); nulls come first, and rows equal in `by` follow each other in some order.

    Ranges of rows are sorted apart and counted; a range's first number is the count of all before it, and one count a range is all that reaches the driver. Ties are dealt to
    ranges by a number written beside them, so a value that many rows share is no hot range. The result stands on one table of `written`.
    """
    tie, part, at, first = (fresh(n, df) for n in ("kd_tie", "kd_part", "kd_at", "kd_first"))
    kept = written(df.withColumn(tie, F.monotonically_increasing_id()), "rows")
    ranges = kept.repartitionByRange(*by, tie).sortWithinPartitions(*by, tie)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = written(ranges.withColumns({part: F.spark_partition_id(), at: within}).drop(tie), "ranges")
    discard(kept)
    n, starts = 0, []
    for r in placed.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect():
        starts.append((r[part], n))
        n += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, {first} long")
    return placed.join(F.broadcast(offsets), part).select(*df.columns, (F.col(first) + F.col(at)).alias(name)), n


def assign(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """docs with three columns more: kd_row (the global row number from 0), kd_shard (0 to shards - 1) and kd_slot (from 0 without gaps in each shard).

    Rows are numbered in order of id, then of a hash of all their columns. The permuted number, divided by the count of shards, leaves the shard and gives the slot: counts
    of shards are one apart at most, and `Permutation(n, seed)` computes both from a row's number, and the number back from both. Equal rows, null ids and texts are rows
    like others, and what two rows that are equal in all columns get is the same set. An empty table gives no rows. Columns named kd_row, kd_shard or kd_slot are replaced.
    """
    docs = without(docs, "kd_row long, kd_shard int, kd_slot long")
    mark, place = fresh("kd_hash", docs), fresh("kd_place", docs)
    rows, n = numbered(docs.withColumn(mark, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))), [id_col, mark])
    placed = rows.withColumn(place, Permutation(n, seed).column(docs.sparkSession, F.col("kd_row")))
    return placed.select(*docs.columns, "kd_row", (F.col(place) % shards).cast("int").alias("kd_shard"), F.expr(f"`{place}` div {shards}").alias("kd_slot"))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, id_col: str = "doc_id") -> None:
    """`assign`, and all columns as Parquet in a folder a shard (kd_shard=0 and so on), in order of slot; a large shard is many files, cut by slot."""
    assigned = assign(docs, shards, seed, id_col)
    assigned.repartitionByRange("kd_shard", "kd_slot").sortWithinPartitions("kd_shard", "kd_slot").write.partitionBy("kd_shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows of a shard of `write_shards`, from slot `start` to before `end`, in order of slot; other shards and, by statistics, other slots are not read."""
    rows = spark.read.parquet(path).where((F.col("kd_shard") == shard) & (F.col("kd_slot") >= start))
    return (rows if end is None else rows.where(F.col("kd_slot") < end)).orderBy("kd_slot")


def op11_sharding(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8; a null text has none), text_crc32 (0 for a null or empty text), law, shard, slot, grown_shard (null: the law is `rows`), row number.

    What `assign` numbers are the ids with sizes and checksums of texts: texts stay where they are.
    """
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return assign(slim, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("kd_shard").alias("shard"), F.col("kd_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("kd_row").alias("row")
    )


def _sql(shards: int = 24, seed: int = 0, rounds: int = 6) -> str:
    """The same permutation: rounds are nested selections over (l, r), and a recursive step walks what is still at n or above."""

    def mix(x: str) -> str:
        for shift, factor in ((16, FIRST), (13, SECOND)):
            x = f"CAST(CAST(xor({x}, ({x}) >> {shift}) AS HUGEINT) * {factor} % {WORD + 1} AS BIGINT)"
        return x

    def network(source: str) -> str:
        out = f"SELECT doc_id, n, h, x >> h AS l, x & ((1 << h) - 1) AS r FROM {source}"
        for key in Permutation(1, seed, rounds).keys:
            for x in (f"(r + {key}) & {WORD}", mix("m"), "xor(m, m >> 16)"):
                out = f"SELECT * {'EXCLUDE m' if 'm' in x else ''}, {x} AS m FROM ({out})"
            out = f"SELECT doc_id, n, h, r AS l, xor(l, m & ((1 << h) - 1)) AS r FROM ({out})"
        return f"SELECT doc_id, n, h, (l << h) | r AS x FROM ({out})"

    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS body, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n FROM documents),
h AS (SELECT doc_id, n, x, CAST(greatest(1, ceil(ceil(log2(greatest(n, 2))) / 2)) AS INTEGER) AS h FROM d),
walk AS ({network("h")} UNION ALL {network("(SELECT * FROM walk WHERE x >= n)")})
SELECT d.doc_id, octet_length(encode(body)) + 8 AS size,
 xor(list_reduce(list_transform(regexp_extract_all(hex(body), '..'), lambda b: CAST('0x' || b AS BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
 'rows' AS law, CAST(walk.x % {shards} AS INTEGER) AS shard, CAST(walk.x // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, d.x AS row
FROM d JOIN walk ON walk.doc_id = d.doc_id AND walk.x < walk.n, crc
"""


OP11_SQL = _sql()
