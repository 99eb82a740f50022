"""Class hierarchies: edges, closures, layers and the hierarchy table. All ontologies (kg) go through one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.terms import PROPERTY_PREDICATES, union_pieces
from kindred.operators.blocks import lookup
from kindred.plans.scratch import discard, written


def etype_properties(triples: DataFrame) -> DataFrame:
    """(kg, etype, property): the bag of types that a property's domain or range names; a union counts for each of its members."""
    own = triples.where(F.col("predicate_term").isin(*PROPERTY_PREDICATES) & F.col("object_term").isNotNull())
    return own.select("kg", F.explode(union_pieces(F.col("object_term"))).alias("etype"), F.col("subject_term").alias("property"))


def declared_classes(triples: DataFrame) -> DataFrame:
    """(kg, etype): the bag of declared classes."""
    return triples.where((F.col("predicate_term") == "type") & (F.col("object_term") == "Class") & F.contains("subject", F.lit("http"))).select("kg", F.col("subject_term").alias("etype"))


def subclass_edges(triples: DataFrame, unions: bool = False) -> DataFrame:
    """(kg, child, parent): the bag of direct edges. Edges of blank nodes, whose term is "BNode", stay out unless `unions` asks for them."""
    own = triples.where(F.contains(F.lower("predicate_term"), F.lit("subclass")) & ~F.contains("object_term", F.lit("|")))
    own = own if unions else own.where(F.col("object_term") != "BNode")
    return own.select("kg", F.col("subject_term").alias("child"), F.col("object_term").alias("parent"))


def ancestor_distances(edges: DataFrame, longest: bool = False) -> DataFrame:
    """(kg, node, ancestor, distance): all ancestors over one step or more and the fewest steps to each, without loops of one node; on a longer cycle a node is its own ancestor.
    With `longest`, the most steps too; that needs a graph without cycles, and fails on others.

    Paths double each round, so rounds grow with the logarithm of the depth. Each round's table is written, which cuts lineage, and the one before it deleted.
    """
    one = edges.where("child != parent").select("kg", F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    now = written(one.withColumn("longest", F.lit(1)) if longest else one, "closure")
    sizes = [F.count("*"), F.sum("distance"), *([F.sum("longest"), F.max(F.col("node") == F.col("ancestor"))] if longest else [])]
    best = [F.min("distance").alias("distance"), *([F.max("longest").alias("longest")] if longest else [])]
    size = now.agg(*sizes).first()
    while True:
        if longest and size[3]:
            raise ValueError("longest paths need a graph without cycles")
        lengths = now.columns[3:]
        on = now.select("kg", F.col("node").alias("mid"), F.col("ancestor").alias("further"), *(F.col(c).alias(f"{c}_on") for c in lengths))
        both = lookup(now.withColumnRenamed("ancestor", "mid"), on, ["kg", "mid"])  # a root may have all nodes below it
        further = both.select("kg", "node", F.col("further").alias("ancestor"), *((F.col(c) + F.col(f"{c}_on")).alias(c) for c in lengths))
        old, now = now, written(now.unionByName(further).groupBy("kg", "node", "ancestor").agg(*best), "closure")
        discard(old)
        if (grown := now.agg(*sizes).first()) == size:
            return now
        size = grown


def ancestor_closure(edges: DataFrame) -> DataFrame:
    """(kg, node, ancestor) of `ancestor_distances`."""
    return ancestor_distances(edges).select("kg", "node", "ancestor")


def descendant_closure(closure: DataFrame) -> DataFrame:
    """(kg, node, descendant): the same closure from above."""
    return closure.select("kg", F.col("ancestor").alias("node"), F.col("node").alias("descendant"))


def roots(properties: DataFrame, edges: DataFrame) -> DataFrame:
    """(kg, etype): types with a property and without a direct parent."""
    return properties.select("kg", "etype").distinct().join(edges.select("kg", F.col("child").alias("etype")).distinct(), ["kg", "etype"], "left_anti")


def layers(properties: DataFrame, edges: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """(kg, etype, layer): depth below the nearest root, from 1. Types that no root reaches have no row (their layer is 1). distances: `ancestor_distances` of the edges, if they are there.

    Exact where a type's parents share a layer, as in trees; for others see layers_in_order.
    """
    distances = ancestor_distances(edges) if distances is None else distances
    tops = roots(properties, edges)
    below = distances.join(tops.select("kg", F.col("etype").alias("ancestor")), ["kg", "ancestor"]).groupBy("kg", F.col("node").alias("etype")).agg((F.min("distance") + 1).cast("int").alias("layer"))
    return tops.withColumn("layer", F.lit(1)).unionByName(below)


def layers_in_order(properties: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """(kg, etype, layer) where parents may lie on different layers, by the rule of a queue that serves types breadth-first in order of appearance: each type is
    served once, when it is reached first, and hands the layer below its own of that moment to its children; what the last parent handed down stays.

    properties and edges carry `order`, their place in the source; ties go by name. Types that no root reaches have no row. A breadth is a round: the types that it reaches are sorted over ranges by the
    parent that reaches them first, then by place, and take numbers that rise with that order. With the numbers, the parent that a type's layer comes from at its turn (the last one
    served before it) and the one that it ends with (the last of all) are greatest rows; layers are lengths of chains of the former, found by doubling.
    """
    steps = written(edges.where("child != parent").select("kg", "child", "parent", F.col(order).alias("at")), "steps")
    tops = properties.groupBy("kg", "etype").agg(F.min(order).alias("at")).join(edges.select("kg", F.col("child").alias("etype")).distinct(), ["kg", "etype"], "left_anti")
    served = front = _numbered(tops.select("kg", "etype", F.struct(F.lit(0).cast("long").alias("by"), "at").alias("first")), 0)
    fronts = [front]
    while True:
        below = steps.join(front.select("kg", F.col("etype").alias("parent"), "number"), ["kg", "parent"]).groupBy("kg", F.col("child").alias("etype")).agg(F.min(F.struct(F.col("number").alias("by"), "at")).alias("first"))
        front = _numbered(below.join(served.select("kg", "etype"), ["kg", "etype"], "left_anti"), len(fronts))
        fronts.append(front)
        if front.isEmpty():
            break
        served = served.unionByName(front)
    turn = lambda name: served.select("kg", F.col("etype").alias(name), F.struct("breadth", "number").alias(f"{name}_turn"))
    both = steps.join(turn("parent"), ["kg", "parent"]).join(turn("child"), ["kg", "child"])
    handed = F.struct("parent_turn", "parent")
    last = both.groupBy("kg", "child").agg(F.max(F.when(F.col("parent_turn") < F.col("child_turn"), handed))["parent"].alias("guide"), F.max(handed)["parent"].alias("last"))
    every = written(served.join(last.select("kg", F.col("child").alias("etype"), "guide", "last"), ["kg", "etype"], "left").select("kg", "etype", "guide", "last"), "handed")
    depth = _chain_lengths(every.select("kg", F.col("etype").alias("node"), F.col("guide").alias("up")))
    out = every.join(depth.select("kg", F.col("node").alias("last"), "length"), ["kg", "last"], "left").select("kg", "etype", F.when(F.col("last").isNull(), 1).otherwise(F.col("length") + 2).cast("int").alias("layer"))
    discard(steps, *fronts)
    return out


def _numbered(found: DataFrame, breadth: int) -> DataFrame:
    """(kg, etype, breadth, number) of types in order of their `first`: numbers rise with it, over ranges that are sorted apart."""
    ranges = found.repartitionByRange("kg", "first", "etype").sortWithinPartitions("kg", "first", "etype")
    return written(ranges.select("kg", "etype", F.lit(breadth).alias("breadth"), F.monotonically_increasing_id().alias("number")), "front")


def _chain_lengths(links: DataFrame) -> DataFrame:
    """(kg, node, length): steps from node along (node, up) to one whose `up` is null. Chains double each round."""
    now = written(links.select("kg", "node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("length")), "chains")
    while not now.where("up is not null").isEmpty():
        on = now.select("kg", F.col("node").alias("up"), F.col("up").alias("further"), F.col("length").alias("more"))
        old, now = now, written(now.join(on, ["kg", "up"], "left").select("kg", "node", F.col("further").alias("up"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")), "chains")
        discard(old)
    return now


def hierarchy_table(properties: DataFrame, edges: DataFrame, closure: DataFrame, layered: DataFrame) -> DataFrame:
    """(kg, etype, super_classes, sub_classes, path, all_sub_classes, layer, type): sorted arrays, null where there is none."""
    names = properties.select("kg", "etype").unionByName(edges.select("kg", F.col("child").alias("etype"))).unionByName(edges.select("kg", F.col("parent").alias("etype"))).distinct()

    def lists(df: DataFrame, node: str, value: str, name: str) -> DataFrame:
        return df.groupBy("kg", F.col(node).alias("etype")).agg(F.array_sort(F.collect_set(value)).alias(name))

    parts = (lists(edges, "child", "parent", "super_classes"), lists(edges, "parent", "child", "sub_classes"), lists(closure, "node", "ancestor", "path"), lists(closure, "ancestor", "node", "all_sub_classes"))
    for part in parts:
        names = names.join(part, ["kg", "etype"], "left")
    return names.join(layered, ["kg", "etype"], "left").withColumn("layer", F.coalesce("layer", F.lit(1))).withColumn("type", F.lit("class"))
