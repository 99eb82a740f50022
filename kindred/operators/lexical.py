"""Similarities of names by meaning: word vectors and a lexical hierarchy, both given as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.similarity import cosine, levenshtein, longest_common, ngram1
from kindred.functions.terms import name_words
from kindred.operators.blocks import lookup
from kindred.operators.hierarchy import ancestor_distances
from kindred.plans.scratch import written


def pair_words(pairs: DataFrame) -> DataFrame:
    """(label1, label2, w1, w2): each pair's words against each other; names are short, so a pair makes few rows."""
    one = pairs.select("label1", "label2").distinct()
    return one.select("label1", "label2", F.explode(name_words(F.col("label1"))).alias("w1")).withColumn("w2", F.explode(name_words(F.col("label2"))))


def vector_similarity(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """(label1, label2, sim): the greatest cosine of a word of each; at least 0, and 0 for words without a vector. vectors: (word, embedding).

    Cosines are taken of distinct word pairs only.
    """
    distinct = words.select("w1", "w2").distinct()
    one, two = vectors.select(F.col("word").alias("w1"), F.col("embedding").alias("e1")), vectors.select(F.col("word").alias("w2"), F.col("embedding").alias("e2"))
    known = distinct.join(one, "w1").join(two, "w2").groupBy("w1", "w2").agg(F.max(cosine(F.col("e1"), F.col("e2"))).alias("c"))
    return words.join(known, ["w1", "w2"], "left").groupBy("label1", "label2").agg(F.greatest(F.lit(0.0), F.coalesce(F.max("c"), F.lit(0.0))).alias("sim"))


def _upward(hypernyms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ancestor, distance, longest) of all nodes of the graph and of `nodes`, themselves included at 0: fewest and most steps up."""
    paths = ancestor_distances(hypernyms.select(F.lit("").alias("kg"), "child", "parent"), longest=True).drop("kg")
    every = nodes.select("node").unionByName(hypernyms.select(F.col("child").alias("node"))).unionByName(hypernyms.select(F.col("parent").alias("node"))).where("node is not null").distinct()
    return paths.unionByName(every.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"), F.lit(0).alias("longest")))


def depths(hypernyms: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(node, least, most): steps from a node to a root, a node without a parent, on the shortest and on the longest way; 0 for roots. hypernyms: (child, parent), a graph
    without cycles, in which a node may have several parents. up: `_upward` of it, if it is there."""
    up = _upward(hypernyms, hypernyms.select(F.col("child").alias("node"))) if up is None else up
    inner = hypernyms.where("child != parent").select(F.col("child").alias("ancestor")).distinct()
    roots = up.where("distance = 0").select("ancestor").join(inner, "ancestor", "left_anti")
    return lookup(up, roots, ["ancestor"]).groupBy("node").agg(F.min("distance").alias("least"), F.max("longest").alias("most"))


def wu_palmer(pairs: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """(a, b, wup) of distinct pairs of nodes of a graph of (child, parent) without cycles, in which a node may have several parents, lie at several depths, and meet another in several ways.

    Of the common ancestors (a node is its own) the one counts that is deepest by its shortest way to a root; of equal ones a itself, then the first by name. With d one more than that ancestor's longest
    way to a root, wup is 2 d / (d + steps to a + d + steps to b); steps between a node and the ancestor are the fewest by way of any common ancestor of the two. A node outside
    the graph is a root of its own. Null without a common ancestor: give roots a common parent where they should have one. Pairs with a null have no row.
    A node's ancestors are gathered in one list, in the order in which they count, so pairs stay one row each, and what is common to two lists is found within the row.
    """
    wanted = written(pairs.select("a", "b").where("a is not null and b is not null").repartition("a", "b").distinct(), "pairs")  # else a task of the scan would gather all its pairs
    asked = wanted.select(F.col("a").alias("node")).unionByName(wanted.select(F.col("b").alias("node"))).distinct()
    up = written(_upward(hypernyms, asked), "upward")
    own = up.join(asked, "node", "left_semi")
    above = up.select(F.col("node").alias("top"), "ancestor", F.col("distance").alias("more"))
    ways = lookup(own.select("node", F.col("ancestor").alias("top")), above, ["top"])
    steps = ways.join(own.select("node", "ancestor", "distance"), ["node", "ancestor"]).groupBy("node", "top").agg(F.min(F.col("distance") + F.col("more")).alias("steps"))
    placed = lookup(steps, depths(hypernyms, up).withColumnRenamed("node", "top"), ["top"])
    place = F.struct((-F.col("least")).alias("high"), (F.col("top") != F.col("node")).alias("other"), "top", "most", "steps")
    tops = written(placed.groupBy("node").agg(F.array_sort(F.collect_list(place)).alias("tops")), "tops")  # of each node, its ancestors, the one that counts most first
    side = lambda name: tops.select(F.col("node").alias(name), F.col("tops").alias(f"of_{name}"))
    both = lookup(lookup(wanted, side("b"), ["b"]), side("a"), ["a"], counted=wanted)
    met = both.withColumn("top", F.get(F.array_intersect("of_a.top", "of_b.top"), F.lit(0)))
    at = lambda name: F.get(F.filter(name, lambda x: x["top"] == F.col("top")), F.lit(0))
    met = met.select("a", "b", at("of_a").alias("one"), at("of_b").alias("two"))
    d = F.col("one.most") + 1
    return met.select("a", "b", (2.0 * d / (2 * d + F.col("one.steps") + F.col("two.steps"))).alias("wup"))


def synset_similarity(words: DataFrame, synsets: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """(label1, label2, sim): the greatest Wu-Palmer similarity of a synset of each; 0 without any. synsets: (word, synset); hypernyms: (child, parent), see `wu_palmer`."""
    one, two = synsets.select(F.col("word").alias("w1"), F.col("synset").alias("a")), synsets.select(F.col("word").alias("w2"), F.col("synset").alias("b"))
    sense = lookup(lookup(words, one, ["w1"]), two, ["w2"], counted=words).select("label1", "label2", "a", "b")
    sense = written(sense.repartition("label1", "label2", "a", "b").distinct(), "senses")
    scored = lookup(sense, wu_palmer(sense, hypernyms), ["a", "b"]).groupBy("label1", "label2").agg(F.max("wup").alias("wup"))
    return words.select("label1", "label2").repartition("label1", "label2").distinct().join(scored, ["label1", "label2"], "left").select("label1", "label2", F.coalesce("wup", F.lit(0.0)).alias("sim"))


def string_similarities(pairs: DataFrame, vectors: DataFrame | None = None, synsets: DataFrame | None = None, hypernyms: DataFrame | None = None, substring: bool = False) -> DataFrame:
    """pairs with ngram1, longest_com_sub, levenshtein, wordnet_sim and word2vec_sim; distinct label pairs are scored once and joined back. Without tables the last two are 0."""
    one = pairs.select("label1", "label2").distinct()
    a, b = F.col("label1"), F.col("label2")
    scored = one.select("label1", "label2", ngram1(a, b).alias("ngram1"), longest_common(a, b, substring).alias("longest_com_sub"), levenshtein(a, b).alias("levenshtein"))
    words = pair_words(one)
    for name, table in (("wordnet_sim", synset_similarity(words, synsets, hypernyms) if synsets is not None else None), ("word2vec_sim", vector_similarity(words, vectors) if vectors is not None else None)):
        scored = scored.join(table.withColumnRenamed("sim", name), ["label1", "label2"], "left") if table is not None else scored.withColumn(name, F.lit(0.0))
        scored = scored.withColumn(name, F.coalesce(name, F.lit(0.0)))
    return pairs.join(scored, ["label1", "label2"])
