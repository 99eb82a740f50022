"""Graphs with several parents, products in blocks, and samples by walks, each against a plain version."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import blocks, hierarchy, lexical, pairs


def edges_of(spark, edges):
    return spark.createDataFrame(edges, "child string, parent string")


def random_dag(seed, n):
    r = random.Random(seed)
    return sorted({(f"n{i}", f"n{r.randrange(i)}") for i in range(1, n) for _ in range(r.randrange(0, 4))})


def plain_paths(edges):
    """{(node, ancestor): lengths of all ways}, a node's own with 0."""
    up = {}
    nodes = {x for e in edges for x in e}
    parents = {x: [p for c, p in edges if c == x] for x in nodes}

    def walk(x, at, d):
        up.setdefault((x, at), set()).add(d)
        for p in parents[at]:
            walk(x, p, d + 1)

    for x in nodes:
        walk(x, x, 0)
    return up, {x for x in nodes if not parents[x]}


def plain_wup(edges, a, b):
    up, roots = plain_paths(edges)
    for x in (a, b):
        up.setdefault((x, x), {0})
    roots |= {x for x in (a, b) if not any(x in e for e in edges)}
    above = lambda x: {y for n, y in up if n == x}
    depth = lambda x, f: f(f(up[x, r]) for r in above(x) if r in roots)
    common = above(a) & above(b)
    if not common:
        return None
    top = min(common, key=lambda x: (-depth(x, min), x != a, x))
    d = depth(top, max) + 1
    steps = lambda x: min(min(up[x, y]) + min(up[top, y]) for y in above(x) & above(top))
    return 2 * d / (2 * d + steps(a) + steps(b))


def test_depths_of_a_diamond(spark):
    """x hangs on a and b, both on r; y on x and on r: the shortest and the longest way up, not the number of ancestors."""
    e = edges_of(spark, [("x", "a"), ("x", "b"), ("a", "r"), ("b", "r"), ("y", "x"), ("y", "r"), ("r", "r")])
    assert {r.node: (r.least, r.most) for r in lexical.depths(e).collect()} == {"r": (0, 0), "a": (1, 1), "b": (1, 1), "x": (2, 2), "y": (1, 3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_wu_palmer_of_random_graphs(spark, seed):
    edges = random_dag(seed, 18)
    nodes = [*sorted({x for e in edges for x in e}), "alone"]
    both = spark.createDataFrame([*itertools.product(nodes, nodes), (None, "n1")], "a string, b string")
    got = {(r.a, r.b): r.wup for r in lexical.wu_palmer(both, edges_of(spark, edges)).collect()}
    want = {(a, b): plain_wup(edges, a, b) for a, b in itertools.product(nodes, nodes)}
    assert got.keys() == want.keys() and got["alone", "alone"] == 1 and got["alone", nodes[0]] is None
    assert all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in want.items())


def test_synsets(spark):
    """The best of all senses; words without any, or without a common ancestor, give 0."""
    e = edges_of(spark, [("dog", "canine"), ("canine", "animal"), ("dog", "pet"), ("pet", "animal"), ("cat", "pet"), ("car", "thing")])
    synsets = spark.createDataFrame([("dog", "dog"), ("dog", "car"), ("cat", "cat"), ("vehicle", "car"), ("odd", None)], "word string, synset string")
    words = spark.createDataFrame([("D", "C", "dog", "cat"), ("C", "V", "cat", "vehicle"), ("D", "V", "dog", "vehicle"), ("O", "D", "odd", "dog"), ("N", "D", "none", "dog")], "label1 string, label2 string, w1 string, w2 string")
    got = {(r.label1, r.label2): r.sim for r in lexical.synset_similarity(words, synsets, e).collect()}
    assert got == {("D", "C"): pytest.approx(2 * 2 / (2 * 2 + 1 + 1)), ("C", "V"): 0, ("D", "V"): 1, ("O", "D"): 0, ("N", "D"): 0}
    none = lexical.synset_similarity(words, synsets, e.limit(0))
    assert {(r.label1, r.label2): r.sim for r in none.collect()}["D", "V"] == 1


def test_longest_ways_need_no_cycle(spark):
    e = spark.createDataFrame([("k", "a", "b"), ("k", "b", "c"), ("k", "c", "a"), ("k", "d", "a")], "kg string, child string, parent string")
    assert {(r.node, r.ancestor): r.distance for r in hierarchy.ancestor_distances(e).collect() if r.node in "ad"} == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 3}
    with pytest.raises(ValueError, match="cycles"):
        hierarchy.ancestor_distances(e, longest=True)


def plain_layers(properties, edges):
    """The queue's rule, a type at a time."""
    children, parents = {}, {c for c, _ in edges}
    for c, p in edges:
        children.setdefault(p, []).append(c)
    layer = {x: 1 for x in dict.fromkeys(properties) if x not in parents}
    queue = list(layer)
    done = set()
    for q in queue:
        if q not in done:
            done.add(q)
            for c in children.get(q, []):
                if c != q:
                    queue.append(c)
                    layer[c] = layer[q] + 1
    return layer


@pytest.mark.parametrize("seed", [4, 5])
def test_layers_of_random_graphs(spark, seed):
    """Mixed depths, loops, cycles below roots, and two ontologies at once."""
    r = random.Random(seed)
    rows, tops, want = [], [], set()
    for kg in ("k", "l"):
        edges = [(c, p) for c, p in random_dag(seed + ord(kg), 25)]
        r.shuffle(edges)
        edges += [("n5", "n5"), ("n7", "n20")]
        props = [x for x in [f"n{i}" for i in range(25)] if r.random() < 0.8 or not any(c == x for c, _ in edges)]
        rows += [(kg, c, p, i) for i, (c, p) in enumerate(edges)]
        tops += [(kg, x, i) for i, x in enumerate(props)]
        want |= {(kg, x, k) for x, k in plain_layers(props, edges).items()}
    own = spark.createDataFrame(tops, "kg string, etype string, at int").withColumn("property", F.lit("p"))
    got = hierarchy.layers_in_order(own, spark.createDataFrame(rows, "kg string, child string, parent string, at int").repartition(3), "at")
    assert {tuple(x) for x in got.select("kg", "etype", "layer").collect()} == want


def test_layers_without_roots(spark):
    own = spark.createDataFrame([], "kg string, etype string, property string, at int")
    e = spark.createDataFrame([("k", "a", "b", 1)], "kg string, child string, parent string, at int")
    assert hierarchy.layers_in_order(own, e, "at").count() == 0 and hierarchy.layers(own, e).count() == 0


def test_products_in_blocks(spark):
    left = spark.createDataFrame([(k, f"a{i}") for k, n in (("x", 100), ("y", 3), ("z", 4)) for i in range(n)], "k string, a string")
    right = spark.createDataFrame([(k, f"b{i}", i) for k, n in (("x", 70), ("y", 5), ("w", 4)) for i in range(n)], "k string, b string, c int")
    for block in (1, 7, 1000):
        got = sorted(map(tuple, blocks.product(left, right, ["k"], block).collect()))
        assert got == sorted((k, f"a{i}", f"b{j}", j) for k, n, m in (("x", 100, 70), ("y", 3, 5)) for i in range(n) for j in range(m))
    made = blocks.product(left, right, ["k"], 7)
    assert "NestedLoop" not in made._jdf.queryExecution().toString() and "CartesianProduct" not in made._jdf.queryExecution().toString()
    assert blocks.product(left.limit(0), right, ["k"]).count() == 0


def test_a_large_key_is_many_even_tasks(spark):
    """One value of the key, 40,000 x 400 rows: pairs of blocks spread over 16 partitions, none of which holds twice the median."""
    left, right = spark.range(40_000).selectExpr("'x' as k", "id as a"), spark.range(400).selectExpr("'x' as k", "id as b")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = sorted(r["count"] for r in blocks.product(left, right, ["k"]).groupBy(F.spark_partition_id()).count().collect())
    finally:
        for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 16_000_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_of_a_frequent_key(spark, how):
    """40,000 rows of one key beside others, some without a match and null ones: rows as of a plain join, the key's spread over the partitions."""
    many = spark.range(40_100).selectExpr("case when id < 40000 then 'top' when id < 40050 then 'k' || id when id < 40098 then 'x' end as k", "id as a")
    few = spark.createDataFrame([("top", 1), ("top", 2), (None, 3), ("y", 4), *((f"k{i}", i) for i in range(40_000, 40_050))], "k string, b int")
    plain = many.join(few, ["k"], how)
    assert sorted(map(tuple, blocks.lookup(many, few, ["k"], how, heavy=1000).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        sizes = [r["count"] for r in blocks.lookup(many, few, ["k"], how, counted=many.select("k"), heavy=1000).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == plain.count() and max(sizes) < 40_000


@pytest.mark.parametrize("seed", [3])
def test_wu_palmer_with_frequent_nodes(spark, monkeypatch, seed):
    """The same results where nearly all keys are frequent, and joins that are dealt by parts and aren't broadcast."""
    monkeypatch.setattr(blocks, "HEAVY", 2)
    edges = random_dag(seed, 14)
    nodes = sorted({x for e in edges for x in e})
    made = lexical.wu_palmer(spark.createDataFrame([*itertools.product(nodes, nodes)], "a string, b string"), edges_of(spark, edges))
    assert {(r.a, r.b): r.wup for r in made.collect()} == {(a, b): w if (w := plain_wup(edges, a, b)) is None else pytest.approx(w) for a, b in itertools.product(nodes, nodes)}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("kd_part") > 0


@pytest.mark.parametrize("n", [1, 2, 3, 64, 97, 4096, 10**6])
@pytest.mark.parametrize("seed", [0, 42])
def test_walks_come_by_all_numbers(n, seed):
    start, step = pairs.walk(n, seed)
    assert 0 <= start < n and math.gcd(step, n) == 1 and len({(start + t * step) % n for t in range(n)}) == n


def plain_sample(left, right, matched, k, seed):
    left, right = sorted(left), sorted(right)
    start, step = pairs.walk(len(left) * len(right), seed)
    walked = (divmod((start + t * step) % (len(left) * len(right)), len(right)) for t in itertools.count())
    return list(itertools.islice((p for i, j in walked if (p := (left[i], right[j])) not in matched), k))


def test_samples_of_several_alignments(spark, monkeypatch):
    """As many as there are, some, and none; large numbers of pairs are not made."""
    monkeypatch.setattr(pairs, "CHUNK", 7)
    sides = {"a": ([f"l{i}" for i in range(13)], [f"r{i}" for i in range(9)]), "b": (["x", "y"], ["z"]), "c": ([f"l{i}" for i in range(30)], [f"r{i}" for i in range(40)])}
    matched = {"a": {("l1", "r1"), ("l2", "r0"), ("l12", "r8")}, "b": {("x", "z")}, "c": {(f"l{i}", f"r{j}") for i in range(25) for j in range(30)}}
    ks = {"a": 13 * 9 - 3, "b": 1, "c": 200}
    left = spark.createDataFrame([(k, "t", x) for k, (xs, _) in sides.items() for x in xs], "kg1 string, kg2 string, label1 string")
    right = spark.createDataFrame([(k, "t", x) for k, (_, xs) in sides.items() for x in xs], "kg1 string, kg2 string, label2 string")
    known = spark.createDataFrame([(k, "t", *p) for k, ps in matched.items() for p in ps], "kg1 string, kg2 string, label1 string, label2 string")
    sizes = spark.createDataFrame([(k, "t", n) for k, n in ks.items()], "kg1 string, kg2 string, k long")
    got = sorted((r.kg1, r.label1, r.label2) for r in pairs.sample_unmatched(left.repartition(3), right, known, sizes, 42).collect())
    assert got == sorted((k, *p) for k in sides for p in plain_sample(*sides[k], matched[k], ks[k], 42))


def test_a_few_of_many_pairs(spark):
    """Ten of 10^10 pairs."""
    side = lambda k: spark.range(100_000).selectExpr("'a' as kg1", "'b' as kg2", f"format_string('n%05d', id) as label{k}")
    known = spark.createDataFrame([("a", "b", "n00001", "n00002")], "kg1 string, kg2 string, label1 string, label2 string")
    got = pairs.sample_unmatched(side(1), side(2), known, spark.createDataFrame([("a", "b", 10)], "kg1 string, kg2 string, k long"), 7)
    start, step = pairs.walk(10**10, 7)
    assert sorted((r.label1, r.label2) for r in got.collect()) == sorted((f"n{x // 100_000:05d}", f"n{x % 100_000:05d}") for x in ((start + t * step) % 10**10 for t in range(10)))


def test_senses_of_a_frequent_word(spark, monkeypatch):
    """Many labels against one word of two senses: joins on the word are dealt by parts, and no join of the result broadcasts the senses."""
    monkeypatch.setattr(blocks, "HEAVY", 10)
    e = edges_of(spark, [*((f"c{i}", f"n{i % 3}") for i in range(60)), *((f"n{i}", "top") for i in range(3)), ("r", "top")])
    synsets = spark.createDataFrame([*((f"w{i}", f"c{i}") for i in range(60)), ("many", "r"), ("many", "n1")], "word string, synset string")
    words = spark.range(60).selectExpr("'W' || id as label1", "'M' as label2", "'w' || id as w1", "'many' as w2")
    made = lexical.synset_similarity(words, synsets, e)
    assert {r.label1: round(r.sim, 6) for r in made.collect()} == {f"W{i}": round(2 * 2 / (2 * 2 + 1), 6) if i % 3 == 1 else round(2 / (2 + 2 + 1), 6) for i in range(60)}
    assert "kd_part" in made._jdf.queryExecution().optimizedPlan().toString()
