"""Formal contexts in long form: signed weights of (type, property) cells, their frequencies and information gains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.terms import capital_pieces, matrix_tokens, spaced_words, without_stop_words
from kindred.operators.blocks import lookup, product
from kindred.plans.scratch import written

KEYS = ["kg", "etype"]


@dataclass(frozen=True)
class Context:
    """Sparse form: cells (kg, etype, property, v) above 0; unknown (kg, etype, property) cells, which are 0; meta (kg, etype, layer, n_property, appended);
    by_property (kg, property, n, mean, neg, ig): types that have it, mean weight, what all other cells hold, information gain."""

    cells: DataFrame
    unknown: DataFrame
    meta: DataFrame
    by_property: DataFrame


def property_words(properties: DataFrame, split_capitals: bool = False) -> DataFrame:
    """(kg, etype, word): the words of a type's properties without stop words and digits, each once; a type left with none keeps all as they are, repeats too."""
    words = properties.select("kg", "etype", F.explode(spaced_words(F.col("property"))).alias("word"))
    if split_capitals:
        words = words.select("kg", "etype", F.explode(capital_pieces(F.col("word"))).alias("word"))
    words = words.where("kg is not null and etype is not null")
    marked = words.withColumn("kept", F.size(without_stop_words(F.array("word", F.lit("the")))) == 1)  # beside a stop word, only a word that stays is left
    good = marked.where("kept").select(*KEYS, "word").distinct()
    bare = marked.where("not kept").select(*KEYS, "word").join(good.select(KEYS).distinct().hint("merge"), KEYS, "left_anti")
    return good.unionByName(bare)


def token_counts(words: DataFrame) -> DataFrame:
    """(kg, etype, property, cnt): the count matrix without its zeros."""
    return words.select(*KEYS, F.explode(matrix_tokens(F.col("word"))).alias("property")).groupBy(*KEYS, "property").agg(F.count("*").alias("cnt"))


def property_counts(words: DataFrame) -> DataFrame:
    return words.groupBy(KEYS).agg(F.count("*").alias("n_property"))


def round3(x: Column) -> Column:
    return F.bround(x, 3)


def build(properties: DataFrame, closure: DataFrame, layered: DataFrame, declared: DataFrame, weight_tag: bool = True, split_capitals: bool = False, inherit_positive: bool = False) -> Context:
    """The context of each ontology.

    A type's own weight of a property is its count times its layer, or the least weight among it and its ancestors that have it. Of the other cells, those
    that a descendant has are unknown (0), the rest minus the truncated mean of the property's weights (or -1 without weight_tag). Classes that are
    declared but have no property come after, on layer 1 with zeros only. inherit_positive gives a type its ancestors' properties too, which plain use does not.
    """
    words = written(property_words(properties, split_capitals), "words")  # each of these tables is read several times
    counted = token_counts(words).join(layered, KEYS, "left").withColumn("layer", F.coalesce("layer", F.lit(1)))
    own = written(counted.select(*KEYS, "property", (F.col("cnt") * F.col("layer")).cast("int").alias("w")), "own")
    types = words.select(KEYS).distinct()
    up = closure.select("kg", F.col("node").alias("etype"), "ancestor")
    above = lookup(up, own.select("kg", F.col("etype").alias("ancestor"), "property", F.col("w").alias("aw")), ["kg", "ancestor"]).groupBy(*KEYS, "property").agg(F.min("aw").alias("aw"))
    how = "full" if inherit_positive else "left"
    cells = own.join(above, [*KEYS, "property"], how).select(*KEYS, "property", F.least("w", "aw").cast("int").alias("v"))
    cells = written(cells.join(types, KEYS, "left_semi"), "cells")
    below = closure.select("kg", F.col("ancestor").alias("etype"), F.col("node").alias("descendant")).join(own.select("kg", F.col("etype").alias("descendant"), "property"), ["kg", "descendant"])
    unknown = below.select(*KEYS, "property").distinct().join(types, KEYS, "left_semi").join(cells.select(*KEYS, "property"), [*KEYS, "property"], "left_anti")

    wide = words.select(*KEYS, "word").distinct().unionByName(up.join(words.select("kg", F.col("etype").alias("ancestor"), "word").distinct(), ["kg", "ancestor"]).select(*KEYS, "word"))
    n_property = wide.join(types, KEYS, "left_semi").groupBy(KEYS).agg(F.countDistinct("word").cast("int").alias("n_property"))
    meta = types.join(layered, KEYS, "left").join(n_property, KEYS, "left").select(*KEYS, F.coalesce("layer", F.lit(1)).alias("layer"), "n_property", F.lit(False).alias("appended"))
    missing = declared.distinct().join(types, KEYS, "left_anti").select(*KEYS, F.lit(1).alias("layer"), F.lit(0).alias("n_property"), F.lit(True).alias("appended"))
    meta = written(meta.unionByName(missing), "meta")

    rows = meta.groupBy("kg").agg(F.count("*").alias("rows"))
    by = cells.groupBy("kg", "property").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).join(rows, "kg")
    n, total = F.col("n").cast("double"), F.col("rows").cast("double")
    log2 = lambda x: round3(F.log2(x))
    rest = F.when(n < total, log2(F.greatest(total - n, F.lit(1.0))) * round3((total - n) / total)).otherwise(F.lit(0.0))
    by = by.select(
        "kg", "property", F.col("n").cast("int").alias("n"), "mean", (-F.floor("mean") if weight_tag else F.lit(-1)).cast("int").alias("neg"), (log2(total) - (log2(n) * round3(n / total) + rest)).alias("ig")
    )
    return Context(cells, unknown, meta, by)


def flat(properties: DataFrame, layered: DataFrame, split_capitals: bool = False) -> DataFrame:
    """(kg, etype, property, v) without inheritance: count times layer, -1 where there is none."""
    words = written(property_words(properties, split_capitals), "words")
    own = written(token_counts(words).join(layered, KEYS, "left").select(*KEYS, "property", (F.col("cnt") * F.coalesce("layer", F.lit(1))).cast("int").alias("w")), "own")
    grid = product(words.select(KEYS).distinct(), own.select("kg", "property").distinct(), ["kg"])
    return grid.join(own, [*KEYS, "property"], "left").select(*KEYS, "property", F.coalesce("w", F.lit(-1)).alias("v"))


def dense(c: Context, weight_tag: bool = True) -> DataFrame:
    """(kg, etype, property, v, h, i) of all cells: for export. Its size is types times properties of each ontology, the size of the matrix itself. Without weight_tag, h is -1 below 0."""
    grid = product(c.meta.select(*KEYS, "appended"), c.by_property.select("kg", "property", "n", "neg", "ig"), ["kg"])
    cell = grid.join(c.cells, [*KEYS, "property"], "left").join(c.unknown.withColumn("idk", F.lit(True)), [*KEYS, "property"], "left")
    return cell.select(*KEYS, "property", *values(F.col("v"), F.col("idk").isNotNull() | F.col("appended"), F.col("neg"), F.col("n"), F.col("ig"), weight_tag))


def values(v: Column, zero: Column, neg: Column, n: Column, ig: Column, weight_tag: bool = True) -> list[Column]:
    """v, h and i of a cell: weight; number of types that have the property, with the weight's sign; information gain, times h below 0."""
    weight = F.when(v.isNotNull(), v).when(zero, F.lit(0)).otherwise(neg)
    h = F.signum(weight).cast("int") * n
    h = h if weight_tag else F.greatest(h, F.lit(-1))
    return [weight.alias("v"), h.alias("h"), F.when(weight > 0, ig).otherwise(h * ig).alias("i")]


def wide(cells: DataFrame, value: str) -> DataFrame:
    """One column a property, in order of name: for export of contexts of moderate width."""
    names = [r[0] for r in cells.select("property").distinct().orderBy("property").toLocalIterator()]
    return cells.groupBy(KEYS).pivot("property", names).agg(F.first(value))


def impurity(df: DataFrame, keys: list[str], feature: str, criterion: str) -> DataFrame:
    """(keys, impurity) of a column's values: entropy in bits or Gini, rounded to 3 places."""
    if criterion not in ("entropy", "gini"):
        raise ValueError(f"unknown impurity criterion {criterion}")
    counts = df.groupBy(*keys, feature).agg(F.count("*").alias("k"))
    total = counts.groupBy(*keys).agg(F.sum("k").alias("whole"))
    p = F.col("k").cast("double") / F.col("whole")
    both = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))  # one row
    measure = -F.sum(p * F.log2(p)) if criterion == "entropy" else 1 - F.sum(p * p)
    return both.groupBy(*keys).agg(round3(measure).alias("impurity"))


def information_gain(df: DataFrame, target: str, feature: str, criterion: str) -> DataFrame:
    """(gain): the target's impurity less that of each level of the feature, weighted; parts are rounded to 3 places."""
    whole = impurity(df, [], target, criterion).select(F.col("impurity").alias("all"))
    levels = impurity(df, [feature], target, criterion).join(df.groupBy(feature).agg(F.count("*").alias("k")), feature)
    rows = df.agg(F.count("*").alias("rows"))
    part = levels.crossJoin(F.broadcast(rows)).agg(F.sum(F.col("impurity") * round3(F.col("k") / F.col("rows"))).alias("part"))  # one row each
    return whole.crossJoin(part).select((F.col("all") - F.col("part")).alias("gain"))
