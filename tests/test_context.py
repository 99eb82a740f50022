"""The hand-checked example: matrices and raw scores of a small context, and edge cases of hierarchies."""

import math

import pytest
from pyspark.sql import functions as F

from kindred.operators import context, hierarchy, learn, pairs, scores

TYPES = ["Person", "Author", "Reviewer", "Paper", "Orphan"]
DOMAINS = [("name", "domain", "Person"), ("name", "domain", "Author"), ("writes", "domain", "Author"), ("reviews", "domain", "Reviewer"), ("title", "domain", "Paper"), ("writes", "range", "Paper")]
EDGES = [("Author", "subClassOf", "Person"), ("Reviewer", "subClassOf", "Person")]
V = {"Person": (1, 0, -1, 0), "Author": (1, -2, -1, 2), "Reviewer": (-1, 2, -1, -1), "Paper": (-1, -2, 1, 1), "Orphan": (0, 0, 0, 0)}
H = {"Person": (2, 0, -1, 0), "Author": (2, -1, -1, 2), "Reviewer": (-2, 1, -1, -2), "Paper": (-2, -1, 1, 2), "Orphan": (0, 0, 0, 0)}
I = {"Person": (0.971, 0, -0.722, 0), "Author": (0.971, -0.722, -0.722, 0.971), "Reviewer": (-1.942, 0.722, -0.722, -1.942), "Paper": (-1.942, -0.722, 0.722, 0.971), "Orphan": (0, 0, 0, 0)}
RAW = {("Person", "Person"): (1.0, 3.261536, 0.971), ("Person", "Reviewer"): (0.0, 0.201336, -0.555), ("Author", "Author"): (3.0, 0.818731, 0.971), ("Reviewer", "Person"): (-1.0, 0.201336, -0.555), ("Paper", "Author"): (0.5, -0.545317, -0.43775)}


def triples(spark, rows):
    full = [("k", f"http://x/{s}", p, o, s, p, o) for s, p, o in rows]
    return spark.createDataFrame(full, "kg string, subject string, predicate string, object string, subject_term string, predicate_term string, object_term string")


@pytest.fixture(scope="module")
def small(spark):
    t = triples(spark, EDGES + DOMAINS + [(x, "type", "Class") for x in TYPES])
    own, edges = hierarchy.etype_properties(t), hierarchy.subclass_edges(t)
    return context.build(own, hierarchy.ancestor_closure(edges), hierarchy.layers(own, edges), hierarchy.declared_classes(t))


def test_matrices(small):
    got = {(r.etype, r.property): r for r in context.dense(small).collect()}
    for t in TYPES:
        for k, p in enumerate(("name", "reviews", "title", "writes")):
            r = got[t, p]
            assert (r.v, r.h) == (V[t][k], H[t][k]) and r.i == pytest.approx(I[t][k], abs=1e-9)
    assert {r.etype: r.n_property for r in small.meta.collect()} == {"Person": 1, "Author": 2, "Reviewer": 2, "Paper": 2, "Orphan": 0}


def test_raw_scores_and_missing_properties(spark, small):
    grid = spark.createDataFrame([("k", "k", a, b) for a in TYPES for b in [*TYPES, "Nowhere"]], "kg1 string, kg2 string, label1 string, label2 string")
    mapped = small.by_property.select(F.lit("k").alias("kg1"), F.lit("k").alias("kg2"), F.col("property").alias("p1"), F.col("property").alias("p2"))
    raw = {(r.label1, r.label2): r for r in scores.raw_scores(grid, small, small, mapped).collect()}
    assert len(raw) == 30
    for pair, want in RAW.items():
        assert (raw[pair].raw_v, raw[pair].raw_h, raw[pair].raw_i) == pytest.approx(want, abs=1e-6)
    assert raw["Orphan", "Person"].raw_h is None and raw["Person", "Nowhere"].raw_v == 0
    done = {(r.label1, r.label2): r for r in scores.similarities(grid, scores.raw_scores(grid, small, small, mapped)).collect()}
    assert all(0 <= x <= 1 for r in done.values() for x in (r.sim_v, r.sim_h, r.sim_i)) and done["Author", "Author"].sim_v == 1 and done["Orphan", "Person"].sim_h == 0


def test_loops_cycles_and_mixed_depths(spark):
    e = spark.createDataFrame([("k", "a", "a", 1), ("k", "b", "c", 2), ("k", "c", "b", 3), ("k", "d", "b", 4)], "kg string, child string, parent string, at int")
    got = {(r.node, r.ancestor) for r in hierarchy.ancestor_closure(e).collect()}
    assert got == {("b", "c"), ("c", "b"), ("b", "b"), ("c", "c"), ("d", "b"), ("d", "c")}
    own = spark.createDataFrame([("k", "r", "p", 0), ("k", "s", "p", 1)], "kg string, etype string, property string, at int")
    mixed = spark.createDataFrame([("k", "x", "r", 1), ("k", "y", "x", 2), ("k", "x", "s", 3), ("k", "z", "y", 4), ("k", "y", "s", 5)], "kg string, child string, parent string, at int")
    assert {r.etype: r.layer for r in hierarchy.layers_in_order(own, mixed, "at").collect()} == {"r": 1, "s": 1, "x": 2, "y": 3, "z": 4}


def test_stop_words_unions_nulls_and_repeats(spark):
    t = triples(spark, [("the", "domain", "S"), ("has name", "domain", "A|B"), ("x", "domain", None), ("A", "subClassOf", None), ("A", "type", "Class"), ("A", "type", "Class")])
    own = hierarchy.etype_properties(t)
    words = {(r.etype, r.word) for r in context.property_words(own).collect()}
    assert words == {("S", "the"), ("A", "name"), ("B", "name")}
    c = context.build(own, hierarchy.ancestor_closure(hierarchy.subclass_edges(t)), hierarchy.layers(own, hierarchy.subclass_edges(t)), hierarchy.declared_classes(t))
    assert c.meta.where("appended").count() == 0 and c.meta.count() == 3


def test_sampling_is_exact_seeded_and_checked(spark):
    names = spark.createDataFrame([(k, f"n{i}") for k in "ab" for i in range(12)], "kg string, name string")
    truth = spark.createDataFrame([("a", "b", "n1", "n1")], "kg1 string, kg2 string, e1 string, e2 string")
    one, two = (sorted(map(tuple, pairs.etype_pairs(names.repartition(n), truth, 10).collect())) for n in (1, 5))
    assert one == two and sum(r[4] for r in one) == 5 and len(one) == 55 and len(set(one)) == 51
    with pytest.raises(Exception, match="sample larger"):
        pairs.etype_pairs(names, truth, 40).collect()


def test_measures_without_predictions_and_models(spark):
    none = learn.measures(spark.createDataFrame([(1, 0), (0, 0)], "match int, predict int")).first()
    assert none.precision is None and none.recall == 0 and none.f1 is None
    rows = [(f"x{i}", i % 2, float(i % 2) + 0.01 * (i % 7), 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "label1 string, match int, ngram1 double, levenshtein double")
    train, test = learn.split(df, ["label1"])
    for model in ("DecisionTree", "XGBoost", "LogisticRegression"):
        assert learn.measures(learn.fit_predict(train, test, model, ["ngram1", "levenshtein"])).first().f1 == 1
    with pytest.raises(ValueError):
        learn.classifier("Other", 2)


def test_impurity(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 1)], "t string, f int")
    assert context.impurity(df, [], "t", "entropy").first().impurity == 2 and context.impurity(df, [], "t", "gini").first().impurity == 0.75
    assert context.information_gain(df, "t", "f", "entropy").first().gain == pytest.approx(2 - round(math.log2(3), 3) * 0.75)
    with pytest.raises(ValueError):
        context.impurity(df, [], "t", "other")


def test_words_that_stay_are_read_without_a_join(spark):
    """Types with a word that stays give their words straight from the properties; only bare types are looked for by an anti-join."""
    own = spark.createDataFrame([("k", "a", "the name"), ("k", "a", "of the"), ("k", "b", "the of"), ("k", "b", "the"), ("k", None, "name"), ("l", "a", "the")], "kg string, etype string, property string")
    made = context.property_words(own)
    assert sorted(map(tuple, made.collect())) == [("k", "a", "name"), ("k", "b", "of"), ("k", "b", "the"), ("k", "b", "the"), ("l", "a", "the")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == plan.count("Join LeftAnti") == 1
