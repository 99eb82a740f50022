"""Similarities of names and vectors, and normalisations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngram1(a: Column, b: Column) -> Column:
    """Shared characters, with repeats, over all: shared / (len a + len b - shared); 0 if both are empty."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    chars = F.filter(F.array_distinct(F.split(a, "")), lambda c: c != "")
    shared = F.aggregate(F.transform(chars, lambda c: F.least(count(a, c), count(b, c))), F.lit(0), lambda x, y: x + y)
    return F.coalesce(F.try_divide(shared.cast("double"), (F.length(a) + F.length(b) - shared).cast("double")), F.lit(0.0))


def levenshtein(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 if both are empty."""
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double")), F.lit(1.0))


def lcs_length(a: Column, b: Column, substring: bool = False) -> Column:
    """Length of the longest common subsequence (or substring), by one row of the table after the other; O(len a x len b) a row."""
    xs, ys = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    blank = F.array_repeat(F.lit(0), F.length(b) + 1)

    def subsequence_row(row: Column, x: Column) -> Column:
        # cell j: best of the cell before, of the cell above, and of the diagonal plus a match
        cells = F.transform(ys, lambda y, j: F.greatest(F.get(row, j + 1), F.get(row, j) + F.when(x == y, 1).otherwise(0)))
        start = F.array(F.lit(0))
        return F.aggregate(cells, start, lambda acc, c: F.concat(acc, F.array(F.greatest(c, F.element_at(acc, -1)))))

    def substring_row(row: Column, x: Column) -> Column:
        return F.concat(F.array(F.lit(0)), F.transform(ys, lambda y, j: F.when(x == y, F.get(row, j) + 1).otherwise(F.lit(0))))

    if not substring:
        return F.element_at(F.aggregate(xs, blank, subsequence_row), -1)
    state = F.struct(blank.alias("row"), F.lit(0).alias("best"))
    step = lambda s, x: F.struct(substring_row(s["row"], x).alias("row"), F.greatest(s["best"], F.array_max(substring_row(s["row"], x))).alias("best"))
    return F.aggregate(xs, state, step)["best"]


def longest_common(a: Column, b: Column, substring: bool = False) -> Column:
    return F.coalesce(F.try_divide((2 * lcs_length(a, b, substring)).cast("double"), (F.length(a) + F.length(b)).cast("double")), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _stats(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row a group, joined back rather than a window: a group may be most of the table."""
    c = F.col(column)
    own = df.groupBy(*keys).agg(F.min(c).alias("kd_min"), F.max(c).alias("kd_max"), F.avg(c).alias("kd_avg"), F.stddev_pop(c).alias("kd_dev"))
    return df.join(own, keys) if keys else df.crossJoin(own)


def minmax(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """column scaled to 0..1 within each group; a constant column becomes 0."""
    out = F.coalesce(F.try_divide(F.col(column) - F.col("kd_min"), F.col("kd_max") - F.col("kd_min")), F.lit(0.0))
    return _stats(df, column, keys).withColumn(column, out).select(*df.columns)


def zscore(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """column as distance from its group's mean in standard deviations, cut to 0..1; a constant column becomes 0, a null stays out and becomes 0."""
    z = F.try_divide(F.col(column) - F.col("kd_avg"), F.col("kd_dev"))
    return _stats(df, column, keys).withColumn(column, F.when(z.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)))).select(*df.columns)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_ratio(x: Column, top: Column) -> Column:
    """The logarithm of 10 to base x over that to base `top`, which is ln(top) / ln(x)."""
    return F.try_divide(F.ln(top), F.ln(x))
