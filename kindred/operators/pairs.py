"""Candidate pairs of types and of properties between two ontologies, and property maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.terms import formal_label
from kindred.operators.blocks import product
from kindred.plans.scratch import written

COLUMNS = ["kg1", "kg2", "label1", "label2", "match", "type"]


def _sides(left: DataFrame, right: DataFrame, alignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kg1, kg2, label1) and (kg1, kg2, label2): the distinct names of each alignment's ontologies."""
    ends = alignments.select("kg1", "kg2").distinct()
    side = lambda df, k: ends.join(df.select(F.col("kg").alias(f"kg{k}"), F.col("name").alias(f"label{k}")).distinct(), f"kg{k}").select("kg1", "kg2", f"label{k}")
    return side(left, 1), side(right, 2)


def _grid(left: DataFrame, right: DataFrame, alignments: DataFrame) -> DataFrame:
    """All pairs of names of the two ontologies of each alignment: the product that is asked for, in blocks."""
    return product(*(written(side, "names") for side in _sides(left, right, alignments)), ["kg1", "kg2"])  # a product reads its sides twice


def labelled(grid: DataFrame, truth: DataFrame, kind: str) -> DataFrame:
    known = truth.select("kg1", "kg2", F.col("e1").alias("label1"), F.col("e2").alias("label2"), F.lit(1).alias("match")).distinct()
    return grid.join(known, ["kg1", "kg2", "label1", "label2"], "left").select("kg1", "kg2", "label1", "label2", F.coalesce("match", F.lit(0)).alias("match"), F.lit(kind).alias("type"))


def indexed(names: DataFrame, on: list[str]) -> DataFrame:
    """names with `at`, each row's place from 0 in the order of its other columns among the rows that agree in `on`. Ranges are sorted apart and counted, so nothing gathers in one task."""
    rest = [c for c in names.columns if c not in on]
    ranges = names.repartitionByRange(*on, *rest).sortWithinPartitions(*on, *rest)
    placed = written(ranges.withColumn("kd_part", F.spark_partition_id()).withColumn("kd_id", F.monotonically_increasing_id()), "places")
    counts = placed.groupBy(*on, "kd_part").agg(F.count("*").alias("kd_n"), F.min("kd_id").alias("kd_first"))
    before = Window.partitionBy(*on).orderBy("kd_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = counts.select(*on, "kd_part", "kd_first", F.coalesce(F.sum("kd_n").over(before), F.lit(0)).alias("kd_before"))
    return placed.join(starts, [*on, "kd_part"]).select(*names.columns, (F.col("kd_before") + F.col("kd_id") - F.col("kd_first")).alias("at"))


#: 2^64 divided by the golden ratio: multiples of it, as parts of 2^64, are spread evenly.
GOLDEN = 0x9E3779B97F4A7C15


def _walker(seed: int):
    """`walk` for a seed, as a function that goes to executors whole: they need no installation of this package."""
    golden = GOLDEN

    def walked(n: int) -> tuple[int, int]:
        part = lambda k: n * ((k * golden % (1 << 64)) >> 32) >> 32
        step = max(1, part(seed + 1))
        while math.gcd(step, n) > 1:
            step += 1
        return part(seed + 2), step

    return walked


def walk(n: int, seed: int) -> tuple[int, int]:
    """(start, step) of a walk start + t step modulo n that comes by each of 0 to n - 1 once: the step has no divisor in common with n."""
    return _walker(seed)(n)


def sample_unmatched(left: DataFrame, right: DataFrame, matched: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """(kg1, kg2, label1, label2): sizes.k distinct pairs of each alignment that are not in `matched`, equal whatever the partitioning, and in SQL. Fails where there are fewer.

    left, right: (kg1, kg2, label1) and (kg1, kg2, label2), each once. The pairs of an alignment are numbered n2 * (place of label1) + (place of label2), and `walk` comes by all numbers in a
    scattered order; of its steps those that aren't matched pairs are taken, up to the k-th. So no more than k rows and those of `matched` are made, of however many pairs there are.
    """
    on = ["kg1", "kg2"]
    a, b = indexed(left, on), indexed(right, on)
    count = lambda df, name: df.groupBy(on).agg(F.count("*").alias(name))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    known = matched.select(*on, "label1", "label2").distinct().join(a.withColumnRenamed("at", "at1"), [*on, "label1"]).join(b.withColumnRenamed("at", "at2"), [*on, "label2"])
    spec = sizes.join(count(a, "n1"), on, "left").join(count(b, "n2"), on, "left").join(count(known, "m"), on, "left").select(*on, "k", "n2", (F.col("n1") * F.col("n2")).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))

    walked = F.udf(_walker(seed), "start long, step long")
    enough = F.when(F.col("k") <= F.coalesce("n", F.lit(0)) - F.col("m"), F.col("k")).otherwise(F.raise_error(F.lit("sample larger than population")).cast("long"))
    spec = written(spec.withColumn("k", enough).where("k > 0").withColumn("walk", walked("n")), "walks")  # a row an alignment
    steps = spec.withColumn("chunk", F.explode(F.expr(f"sequence(0, (k + m - 1) div {CHUNK})"))).repartition("kg1", "kg2", "chunk")
    steps = steps.withColumn("t", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least((chunk + 1) * {CHUNK}, k + m) - 1)")))
    number = ((whole("walk.start") + whole("t") * whole("walk.step")) % whole("n")).cast("long")
    drawn = steps.select(*on, "k", "n2", "t", number.alias("x"))
    hits = known.join(spec.select(*on, "n2"), on).select(*on, (F.col("at1") * F.col("n2") + F.col("at2")).alias("x"))
    met = drawn.join(hits, [*on, "x"]).select(*on, "k", "t").withColumn("before", F.row_number().over(Window.partitionBy(on).orderBy("t")) - 1)  # matched pairs among the steps
    skipped = met.where("t - before < k").groupBy(on).agg(F.count("*").alias("skipped"))
    free = drawn.join(hits, [*on, "x"], "left_anti").join(skipped, on, "left").where(F.col("t") < F.col("k") + F.coalesce("skipped", F.lit(0)))
    places = free.select(*on, F.expr("x div n2").alias("at1"), (F.col("x") % F.col("n2")).alias("at2"))
    return places.join(a.withColumnRenamed("at", "at1"), [*on, "at1"]).join(b.withColumnRenamed("at", "at2"), [*on, "at2"]).select(*on, "label1", "label2")


#: Steps of a walk that one row becomes.
CHUNK = 100_000


def _matched_and_others(names: DataFrame, truth: DataFrame, kind: str, copies: int, m_factor: int, seed: int) -> DataFrame:
    """Known pairs of names that both ontologies have, `copies` times each, and m_factor times as many others."""
    left, right = (written(side, "names") for side in _sides(names, names, truth))
    wanted = truth.select("kg1", "kg2", F.col("e1").alias("label1"), F.col("e2").alias("label2")).distinct()
    known = written(wanted.join(left, ["kg1", "kg2", "label1"]).join(right, ["kg1", "kg2", "label2"]).select("kg1", "kg2", "label1", "label2"), "known")
    sizes = known.groupBy("kg1", "kg2").agg((F.count("*") * copies * m_factor).alias("k"))
    marked = lambda df, match: df.select("*", F.lit(match).alias("match"), F.lit(kind).alias("type")).select(COLUMNS)
    repeated = known.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")
    return marked(repeated, 1).unionByName(marked(sample_unmatched(left, right, known, sizes, seed), 0))


def etype_pairs(etypes: DataFrame, truth: DataFrame, m_factor: int = 20, seed: int = 42) -> DataFrame:
    """Matched type pairs m_factor // 2 times each, and m_factor times as many sampled others. Names count once; m_factor is 2 at least."""
    return _matched_and_others(etypes, truth, "Etype", m_factor // 2, m_factor, seed)


def property_pairs(properties: DataFrame, truth: DataFrame, blind: bool, m_factor: int = 20, seed: int = 42) -> DataFrame:
    """blind: all pairs with match -1. Else matched pairs, and m_factor times as many sampled others."""
    if blind:
        return _grid(properties, properties, truth).select("*", F.lit(-1).alias("match"), F.lit("Property").alias("type")).select(COLUMNS)
    return _matched_and_others(properties, truth, "Property", 1, m_factor, seed)


def candidate_pairs(etypes: DataFrame, properties: DataFrame, truth: DataFrame, blind: bool, m_factor: int = 20, seed: int = 42) -> DataFrame:
    return etype_pairs(etypes, truth, m_factor, seed).unionByName(property_pairs(properties, truth, blind, m_factor, seed))


def property_map(properties: DataFrame, alignments: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(kg1, kg2, p1, p2), one p2 for each p1, the last in order of name. With truth, its pairs; without, properties whose formal labels are equal:
    an equi join, not a product."""
    ends = alignments.select("kg1", "kg2").distinct()
    if truth is None:
        names = properties.select("kg", F.col("name"), formal_label(F.col("name")).alias("key")).distinct()
        a = names.select(F.col("kg").alias("kg1"), F.col("name").alias("p1"), "key")
        b = names.select(F.col("kg").alias("kg2"), F.col("name").alias("p2"), "key")
        both = ends.join(a, "kg1").join(b, ["kg2", "key"])
    else:
        names = properties.select("kg", "name").distinct()
        own = truth.select("kg1", "kg2", F.col("e1").alias("p1"), F.col("e2").alias("p2"))
        both = own.join(names.select(F.col("kg").alias("kg1"), F.col("name").alias("p1")), ["kg1", "p1"]).join(names.select(F.col("kg").alias("kg2"), F.col("name").alias("p2")), ["kg2", "p2"])
    return both.groupBy("kg1", "kg2", "p1").agg(F.max("p2").alias("p2"))
