"""Property-based similarities of type pairs, from sparse contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.similarity import minmax, zscore
from kindred.operators.blocks import product
from kindred.operators.context import Context, values
from kindred.plans.scratch import written

PAIR = ["kg1", "kg2", "label1", "label2"]


def _side(c: Context, k: int, pairs: DataFrame, mapped: DataFrame) -> DataFrame:
    """(kg1, kg2, label, p1, v, h, i, np) of one side: the types of the pairs times the mapped properties, the rest of the cells from what each property says."""
    kg, label, p = f"kg{k}", f"label{k}", f"p{k}"
    own = pairs.select("kg1", "kg2", label).distinct()
    meta = c.meta.select(F.col("kg").alias(kg), F.col("etype").alias(label), "n_property", "appended")
    by = c.by_property.select(F.col("kg").alias(kg), F.col("property").alias(p), "n", "neg", "ig")
    grid = product(own.join(meta, [kg, label]), mapped.join(by, [kg, p]), ["kg1", "kg2"])
    keys = [kg, label, p]
    named = lambda df: df.select(F.col("kg").alias(kg), F.col("etype").alias(label), F.col("property").alias(p), *[x for x in df.columns if x not in ("kg", "etype", "property")])
    cell = grid.join(named(c.cells), keys, "left").join(named(c.unknown).withColumn("idk", F.lit(True)), keys, "left")
    v, h, i = values(F.col("v"), F.col("idk").isNotNull() | F.col("appended"), F.col("neg"), F.col("n"), F.col("ig"))
    return cell.select("kg1", "kg2", label, "p1", v.alias(f"v{k}"), h.alias(f"h{k}"), i.alias(f"i{k}"), F.col("n_property").alias(f"np{k}"))


def _signed(s1: Column, s2: Column, weight, n1: Column, n2: Column, signed: bool) -> Column:
    """Mean of two weights over their types' property counts; one that has it and one that has not count against each other."""
    w1, w2 = F.try_divide(weight(s1), n1), F.try_divide(weight(s2), n2)
    minus1, minus2 = F.try_divide(F.lit(-1.0), n1), F.try_divide(F.lit(-1.0), n2)
    if not signed:
        return (w1 + w2) / 2
    return F.when((s1 >= 0) & (s2 >= 0), (w1 + w2) / 2).when((s1 < 0) & (s2 > 0), (minus1 - w2) / 2).when((s2 < 0) & (s1 > 0), (minus2 - w1) / 2).otherwise(F.lit(0.0))


def raw_scores(pairs: DataFrame, c1: Context, c2: Context, mapped: DataFrame, signed: bool = True, symmetric: bool = False) -> DataFrame:
    """(kg1, kg2, label1, label2, raw_v, raw_h, raw_i) of each distinct pair, sums over mapped properties.

    raw_v is plain; a pair with a type that its context lacks, or without a mapped property, has 0 in all. raw_h and raw_i are null where a type has no property to divide by.
    symmetric uses the weight of the side that has the property in both signed cases of raw_v.
    """
    wanted, mapped = written(pairs.select(PAIR).distinct(), "wanted"), written(mapped, "mapped")  # both are read several times
    a, b = _side(c1, 1, wanted, mapped), _side(c2, 2, wanted, mapped)
    both = wanted.join(a, ["kg1", "kg2", "label1"]).join(b, ["kg1", "kg2", "label2", "p1"])
    d = lambda name: F.col(name).cast("double")
    v1, v2 = d("v1"), d("v2")
    v = F.when((v1 > 0) & (v2 > 0), (v1 + v2) / 2).when((v1 < 0) & (v2 > 0), (-1 - v2) / 2).when((v2 < 0) & (v1 > 0), (-1 - (v1 if symmetric else v2)) / 2).otherwise(F.lit(0.0)) if signed else (v1 + v2) / 2
    h = _signed(d("h1"), d("h2"), lambda s: F.exp(0.2 * (1 - s)), d("np1"), d("np2"), signed)
    i = _signed(d("i1"), d("i2"), lambda s: s, d("np1"), d("np2"), signed)
    terms = both.select(*PAIR, v.alias("v"), h.alias("h"), i.alias("i"))
    sum_or_null = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(c))
    summed = terms.groupBy(PAIR).agg(F.sum("v").alias("raw_v"), sum_or_null("h").alias("raw_h"), sum_or_null("i").alias("raw_i"), F.lit(True).alias("there"))
    out = wanted.join(summed, PAIR, "left")
    zero = lambda c: F.when(F.col("there"), F.col(c)).otherwise(F.lit(0.0)).alias(c)
    return out.select(*PAIR, zero("raw_v"), zero("raw_h"), zero("raw_i"))


def similarities(pairs: DataFrame, raw: DataFrame, nan_rows: bool = False) -> DataFrame:
    """pairs with sim_v, sim_h and sim_i, normalised over the rows of each alignment (repeats count).

    sim_v is ln(1 + raw / 5), at least 0, scaled by minimum and maximum; the others are z-scores cut to 0..1. Nulls stay out of means and become 0;
    with nan_rows a null makes all of its alignment 0, as not-a-number does in plain sums.
    """
    keys = ["kg1", "kg2"]
    out = pairs.join(raw, PAIR).withColumn("sim_v", F.ln(1 + 0.2 * F.greatest("raw_v", F.lit(0.0)))).withColumn("sim_h", F.col("raw_h")).withColumn("sim_i", F.col("raw_i"))
    if nan_rows:
        bad = out.groupBy(keys).agg(F.max(F.col("raw_h").isNull()).alias("bad_h"), F.max(F.col("raw_i").isNull()).alias("bad_i"))
        out = out.join(bad, keys).withColumn("sim_h", F.when(~F.col("bad_h"), F.col("sim_h"))).withColumn("sim_i", F.when(~F.col("bad_i"), F.col("sim_i"))).drop("bad_h", "bad_i")
    out = zscore(zscore(minmax(out, "sim_v", keys), "sim_h", keys), "sim_i", keys)
    return out.drop("raw_v", "raw_h", "raw_i")
