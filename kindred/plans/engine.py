"""The steps together: ontologies to contexts, contexts to features, features to a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import context, hierarchy, learn, lexical, pairs, scores
from kindred.plans.scratch import written


class EtypeEngine:
    """All ontologies of a table of triples go through one plan; kg and alignments are keys, not loops."""

    def __init__(self, spark: SparkSession, seed: int = 42):
        self.spark, self.seed = spark, seed

    def hierarchy(self, triples: DataFrame) -> DataFrame:
        """The hierarchy table, which can stand for a schema when its instances are built."""
        own, edges = hierarchy.etype_properties(triples), hierarchy.subclass_edges(triples)
        paths = hierarchy.ancestor_distances(edges)
        return hierarchy.hierarchy_table(own, edges, paths, hierarchy.layers(own, edges, paths))

    def build_context(self, triples: DataFrame, schema: DataFrame | None = None, **options) -> context.Context:
        """Contexts of all ontologies; with `schema`, a hierarchy table, ancestors and layers come from it (entities in place of types)."""
        own = hierarchy.etype_properties(triples)
        if schema is None:
            edges = hierarchy.subclass_edges(triples)
            closure = hierarchy.ancestor_distances(edges)
            layered = hierarchy.layers(own, edges, closure)
        else:
            closure = schema.select("kg", F.col("etype").alias("node"), F.explode("path").alias("ancestor"))
            layered = schema.select("kg", "etype", "layer")
        return context.build(own, closure, layered, hierarchy.declared_classes(triples), **options)

    def match(self, c1: context.Context, c2: context.Context, alignment: DataFrame, blind: bool = False, m_factor: int = 10, **lexicon) -> DataFrame:
        """Feature rows of sampled type pairs of each alignment: kg1, kg2, label1, label2, match, type and eight similarities."""
        ends = alignment.select("kg1", "kg2").distinct()
        etypes = c1.meta.select("kg", F.col("etype").alias("name")).unionByName(c2.meta.select("kg", F.col("etype").alias("name"))).distinct()
        properties = c1.by_property.select("kg", F.col("property").alias("name")).unionByName(c2.by_property.select("kg", F.col("property").alias("name"))).distinct()
        rows = written(pairs.etype_pairs(etypes, alignment, m_factor, self.seed), "pairs")
        mapped = pairs.property_map(properties, ends, None if blind else alignment)
        named = lexical.string_similarities(rows, **lexicon)
        return scores.similarities(named, scores.raw_scores(rows, c1, c2, mapped))

    def train(self, features: DataFrame, model: str = "ANN") -> DataFrame:
        """Predictions for the test rows; copies of a pair are all in training or all in the test."""
        train, test = learn.split(features, ["kg1", "kg2", "label1", "label2"], seed=self.seed)
        return learn.fit_predict(train, test, model)
