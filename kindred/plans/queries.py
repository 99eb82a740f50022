"""Queries over the driver's tables, one an operator, and the same in SQL."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import similarity, terms
from kindred.operators import context, hierarchy, learn, lexical, pairs, scores
from kindred.plans.engine import EtypeEngine
from kindred.plans.scratch import shared_dir, written
from kindred.sources import files, ontology
from kindred.sources.fixtures import BUCKETS, alignment, balances, customers, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums come in any order, so doubles are compared to 6 places; + 0 makes -0 plain."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


# ---- SQL of the fixtures

_A = """
own AS (SELECT DISTINCT 'A1' AS kg, s_nationkey AS nation, 'b' || CAST(floor((s_acctbal + 1000) / 500) AS BIGINT) AS property FROM supplier
  UNION SELECT 'A2', c_nationkey, property FROM (SELECT c_nationkey, 'B_' || CAST(floor((c_acctbal + 1000) / 500) AS BIGINT) AS property FROM customer) b GROUP BY c_nationkey, property HAVING count(*) * 22 >= (SELECT count(*) FROM customer c WHERE c.c_nationkey = b.c_nationkey)),
ep AS (SELECT kg, 'N' || nation AS etype, property FROM own
  UNION ALL SELECT kg, 'R' || n_regionkey, property FROM own JOIN nation ON nation = n_nationkey GROUP BY kg, n_regionkey, property HAVING count(*) >= 2),
edges AS (SELECT kg, 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation, (SELECT DISTINCT kg FROM own)),
declared AS (SELECT kg, child AS etype FROM edges UNION SELECT kg, parent FROM edges UNION SELECT 'A1', 'P' || n_nationkey FROM nation WHERE length(n_name) > 6)
"""
_B = """
bo AS (SELECT DISTINCT c_custkey, c_nationkey, 'y' || year(o_orderdate) || '_' || o_orderstatus AS property FROM customer JOIN orders ON c_custkey = o_custkey),
ep AS (SELECT 'B' AS kg, 'C' || c_custkey AS etype, property FROM bo
  UNION ALL SELECT 'B', 'N' || c_nationkey, property FROM bo GROUP BY c_nationkey, property HAVING count(*) * 100 >= 36 * (SELECT count(*) FROM customer c WHERE c.c_nationkey = bo.c_nationkey)),
edges AS (SELECT 'B' AS kg, 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer),
declared AS (SELECT kg, child AS etype FROM edges UNION SELECT kg, parent FROM edges)
"""
_CLOSURE = """,
closure AS (SELECT kg, child AS node, parent AS ancestor FROM edges WHERE child <> parent UNION SELECT c.kg, c.node, e.parent FROM closure c JOIN edges e ON c.kg = e.kg AND c.ancestor = e.child AND e.child <> e.parent),
types AS (SELECT DISTINCT kg, etype FROM ep),
roots AS (SELECT * FROM types t WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.kg = t.kg AND e.child = t.etype)),
layers AS (SELECT kg, etype, 1 AS layer FROM roots UNION SELECT l.kg, e.child, l.layer + 1 FROM layers l JOIN edges e ON e.kg = l.kg AND e.parent = l.etype)
"""
_FCA = """,
base AS (SELECT kg, etype, property, count(*) AS cnt FROM (SELECT DISTINCT kg, etype, property FROM ep) GROUP BY ALL),
w AS (SELECT b.kg, b.etype, property, CAST(cnt * coalesce(layer, 1) AS INTEGER) AS w FROM base b LEFT JOIN layers l USING (kg, etype)),
cells AS (SELECT o.kg, o.etype, o.property, CAST(least(o.w, coalesce(min(a.w), o.w)) AS INTEGER) AS v FROM w o LEFT JOIN closure c ON c.kg = o.kg AND c.node = o.etype LEFT JOIN w a ON a.kg = o.kg AND a.etype = c.ancestor AND a.property = o.property GROUP BY o.kg, o.etype, o.property, o.w),
unknown AS (SELECT DISTINCT c.kg, c.ancestor AS etype, d.property FROM closure c JOIN w d ON d.kg = c.kg AND d.etype = c.node JOIN types t ON t.kg = c.kg AND t.etype = c.ancestor WHERE NOT EXISTS (SELECT 1 FROM cells x WHERE x.kg = c.kg AND x.etype = c.ancestor AND x.property = d.property)),
np AS (SELECT t.kg, t.etype, CAST(count(DISTINCT e.property) AS INTEGER) AS n_property FROM types t JOIN (SELECT kg, etype, property FROM ep UNION ALL SELECT c.kg, c.node, e.property FROM closure c JOIN ep e ON e.kg = c.kg AND e.etype = c.ancestor) e ON e.kg = t.kg AND e.etype = t.etype GROUP BY t.kg, t.etype),
meta AS (SELECT t.kg, t.etype, coalesce(l.layer, 1) AS layer, n_property, false AS appended FROM types t LEFT JOIN layers l USING (kg, etype) JOIN np USING (kg, etype)
  UNION ALL SELECT kg, etype, 1, 0, true FROM declared d WHERE NOT EXISTS (SELECT 1 FROM types t WHERE t.kg = d.kg AND t.etype = d.etype)),
nrows AS (SELECT kg, CAST(count(*) AS DOUBLE) AS big FROM meta GROUP BY kg),
byp AS (SELECT c.kg, property, count(*) AS n, avg(v) AS mean, CAST(-floor(avg(v)) AS INTEGER) AS neg, any_value(big) AS big FROM cells c JOIN nrows r ON r.kg = c.kg GROUP BY c.kg, property),
ig AS (SELECT *, round_even(log2(big), 3) - (round_even(log2(n), 3) * round_even(n / big, 3) + CASE WHEN n < big THEN round_even(log2(big - n), 3) * round_even((big - n) / big, 3) ELSE 0 END) AS ig FROM byp),
vcells AS (SELECT m.kg, m.etype, p.property, CASE WHEN c.v IS NOT NULL THEN c.v WHEN u.property IS NOT NULL OR m.appended THEN 0 ELSE p.neg END AS v, n, ig FROM meta m JOIN ig p ON p.kg = m.kg LEFT JOIN cells c ON c.kg = m.kg AND c.etype = m.etype AND c.property = p.property LEFT JOIN unknown u ON u.kg = m.kg AND u.etype = m.etype AND u.property = p.property),
fca AS (SELECT kg, etype, property, CAST(v AS INTEGER) AS v, CAST(sign(v) * n AS INTEGER) AS h, CASE WHEN v > 0 THEN ig ELSE sign(v) * n * ig END AS i FROM vcells)
"""
_SCORES = """,
mapped AS (SELECT a.property AS p1, max(b.property) AS p2 FROM (SELECT DISTINCT property FROM fca WHERE kg = 'A1') a JOIN (SELECT DISTINCT property FROM fca WHERE kg = 'A2') b ON lower(regexp_replace(a.property, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(b.property, '[^A-Za-z0-9]', '', 'g')) GROUP BY a.property),
pr AS (SELECT 'A1' AS kg1, 'A2' AS kg2, a.etype AS label1, b.etype AS label2, CAST(a.n_property AS DOUBLE) AS n1, CAST(b.n_property AS DOUBLE) AS n2 FROM meta a, meta b WHERE a.kg = 'A1' AND b.kg = 'A2'),
cell AS (SELECT kg1, kg2, label1, label2, nullif(n1, 0) AS n1, nullif(n2, 0) AS n2, x.v AS v1, y.v AS v2, x.h AS h1, y.h AS h2, x.i AS i1, y.i AS i2 FROM pr, mapped JOIN fca x ON x.kg = kg1 AND x.etype = label1 AND x.property = p1 JOIN fca y ON y.kg = kg2 AND y.etype = label2 AND y.property = p2),
term AS (SELECT *, CASE WHEN v1 > 0 AND v2 > 0 THEN (v1 + v2) / 2.0 WHEN v1 < 0 AND v2 > 0 OR v2 < 0 AND v1 > 0 THEN (-1 - v2) / 2.0 ELSE 0 END AS tv,
  CASE WHEN h1 >= 0 AND h2 >= 0 THEN (exp(0.2 * (1 - h1)) / n1 + exp(0.2 * (1 - h2)) / n2) / 2 WHEN h1 < 0 AND h2 > 0 THEN (-1 / n1 - exp(0.2 * (1 - h2)) / n2) / 2 WHEN h2 < 0 AND h1 > 0 THEN (-exp(0.2 * (1 - h1)) / n1 - 1 / n2) / 2 ELSE 0 END AS th,
  CASE WHEN i1 >= 0 AND i2 >= 0 THEN (i1 / n1 + i2 / n2) / 2 WHEN i1 < 0 AND i2 > 0 THEN (-1 / n1 - i2 / n2) / 2 WHEN i2 < 0 AND i1 > 0 THEN (-i1 / n1 - 1 / n2) / 2 ELSE 0 END AS ti FROM cell),
raw AS (SELECT kg1, kg2, label1, label2, CAST(sum(tv) AS DOUBLE) AS raw_v, CASE WHEN count(th) = count(*) THEN sum(th) END AS raw_h, CASE WHEN count(ti) = count(*) THEN sum(ti) END AS raw_i FROM term GROUP BY ALL),
logged AS (SELECT *, ln(1 + 0.2 * greatest(raw_v, 0)) AS lv FROM raw),
stat AS (SELECT min(lv) AS a, max(lv) AS b, avg(raw_h) AS mh, stddev_pop(raw_h) AS dh, avg(raw_i) AS mi, stddev_pop(raw_i) AS di FROM logged),
sims AS (SELECT kg1, kg2, label1, label2, coalesce((lv - a) / nullif(b - a, 0), 0) AS sim_v, CASE WHEN raw_h IS NULL OR dh = 0 THEN 0 ELSE greatest(0, least(1, (raw_h - mh) / nullif(dh, 0))) END AS sim_h, CASE WHEN raw_i IS NULL OR di = 0 THEN 0 ELSE greatest(0, least(1, (raw_i - mi) / nullif(di, 0))) END AS sim_i FROM logged, stat)
"""


def _sql(*parts: str, out: str) -> str:
    return f"WITH RECURSIVE {''.join(parts)} {out}"


def _parts(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    return hierarchy.etype_properties(triples), hierarchy.subclass_edges(triples)


def _context(triples: DataFrame, **options) -> context.Context:
    own, edges = (written(df, name) for df, name in zip(_parts(triples), ("properties", "edges"), strict=True))  # both are read many times
    paths = hierarchy.ancestor_distances(edges)
    return context.build(own, paths, hierarchy.layers(own, edges, paths), hierarchy.declared_classes(triples), **options)


def _one(c: context.Context, kg: str) -> context.Context:
    return context.Context(*(df.where(F.col("kg") == kg) for df in (c.cells, c.unknown, c.meta, c.by_property)))


# ---- terms


@query("""SELECT page_id, CASE WHEN p[-1] = '' AND len(p) > 1 THEN p[-2] ELSE p[-1] END AS term FROM (SELECT page_id, string_split(replace(url, '/', '#'), '#') AS p FROM pages)""")
def local_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", terms.local_name(F.col("url")).alias("term"))


@query("""SELECT page_id, CASE WHEN contains(url, '#') THEN string_split(url, '#')[2] END AS term FROM pages""")
def iri_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", terms.fragment(F.col("url")).alias("term"))


@query("""SELECT p_partkey, lower(regexp_replace(p_name || '_' || p_brand, '[^A-Za-z0-9]', '', 'g')) AS label FROM part""")
def formal_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", terms.formal_label(F.concat_ws("_", "p_name", "p_brand")).alias("label"))


@query("""SELECT c_custkey, lower(trim(translate(c_name, '_-', ''))) AS label FROM customer""")
def quick_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", terms.quick_label(F.col("c_name")).alias("label"))


@query("""SELECT DISTINCT o_orderpriority, array_to_string(list_transform(CASE WHEN contains(o_orderpriority, '_') THEN string_split(o_orderpriority, '_') WHEN contains(o_orderpriority, '-') THEN string_split(o_orderpriority, '-') ELSE regexp_split_to_array(regexp_replace(regexp_replace(o_orderpriority, '([A-Z])([A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g'), '([a-z])([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) END, lambda x: lower(x)), '/') AS words FROM (SELECT o_orderpriority FROM orders UNION ALL SELECT 'has' || p_brand || 'Name' FROM part)""")
def word_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select("o_orderpriority").unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("has"), "p_brand", F.lit("Name")).alias("o_orderpriority")))
    return names.distinct().select("o_orderpriority", F.array_join(terms.name_words(F.col("o_orderpriority")), "/").alias("words"))


@query(r"""WITH n AS (SELECT DISTINCT array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS name FROM part)
SELECT name, array_to_string(string_split(regexp_replace(regexp_replace(replace(name, ' ', ''), '([A-Z])([A-Z][a-z])', '\1' || chr(1) || '\2', 'g'), '([a-z])([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), '/') AS words FROM n""")
def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.initcap("p_name").alias("name")).distinct()
    return names.select("name", F.array_join(terms.camel_words(F.replace("name", F.lit(" "), F.lit(""))), "/").alias("words"))


@query("""SELECT DISTINCT p_brand, array_to_string(list_transform(regexp_extract_all(p_brand, '.[^A-Z]*'), lambda x: replace(x, '-', '')), '/') AS pieces FROM part""")
def capital_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", F.array_join(terms.capital_pieces(F.col("p_brand")), "/").alias("pieces"))


@query("""SELECT n_regionkey, unnest(string_split(string_agg(n_name, '|' ORDER BY n_name), '|')) AS member FROM nation GROUP BY n_regionkey""")
def union_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "|").alias("u"))
    return joined.select("n_regionkey", F.explode(terms.union_pieces(F.col("u"))).alias("member"))


@query("""SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS label FROM nation GROUP BY n_regionkey""")
def union_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.concat(F.lit(" onto."), x)), "|").alias("u"))
    return joined.select("n_regionkey", terms.union_label(F.col("u")).alias("label"))


@query("""WITH t AS (SELECT 'http://x/' || n_name AS iri, n_name AS term, 'label ' || lower(n_name) AS label FROM nation) SELECT iri, CASE WHEN regexp_matches(term, 'ERO|OBI|BFO|IAO|RO|SWO|ARG|FLOPO|PATO|PO|ENVO') THEN CASE WHEN length(term) % 2 = 0 THEN label ELSE iri END ELSE term END AS term FROM t""")
def coded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    iri = F.concat(F.lit("http://x/"), "n_name")
    rows = table(spark, sf_dir, "nation").select(iri.alias("subject"), F.lit("p").alias("predicate"), F.lit("o").alias("object"), F.col("n_name").alias("subject_term"), F.lit("p").alias("predicate_term"), F.lit("o").alias("object_term"))
    named = table(spark, sf_dir, "nation").where(F.length("n_name") % 2 == 0).select(iri.alias("iri"), F.concat(F.lit("label "), F.lower("n_name")).alias("label"))
    return terms.with_labels(rows, named).select(F.col("subject").alias("iri"), F.col("subject_term").alias("term"))


@query(
    f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM documents),
f AS (SELECT doc_id, words, list_filter(words, lambda x: NOT list_contains([{", ".join(repr(w) for w in terms.STOP_WORDS)}], lower(x)) AND NOT regexp_full_match(x, '[0-9]+')) AS kept FROM w)
SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words, CAST(CASE WHEN len(kept) = 0 THEN len(words) ELSE len(kept) END AS INTEGER) AS n_kept FROM f"""
)
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = terms.spaced_words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n_words"), F.size(terms.without_stop_words(F.col("w"))).alias("n_kept"))


# ---- hierarchy


@query(_sql(_A, out="SELECT kg, etype, property FROM ep"))
def etype_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.etype_properties(balances(spark, sf_dir))


@query(_sql(_A, out="SELECT kg, etype FROM declared"))
def declared_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.declared_classes(balances(spark, sf_dir))


@query(_sql(_A, out="SELECT kg, child, parent FROM edges"))
def subclass_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.subclass_edges(balances(spark, sf_dir))


@query(_sql(_A, _CLOSURE, out="SELECT kg, node, ancestor FROM closure"))
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.ancestor_closure(hierarchy.subclass_edges(balances(spark, sf_dir)))


@query(_sql(_B, _CLOSURE, out="SELECT kg, ancestor AS node, node AS descendant FROM closure"))
def descendant_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendant_closure(hierarchy.ancestor_closure(hierarchy.subclass_edges(customers(spark, sf_dir))))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), c AS (SELECT a, b FROM e WHERE a <> b UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a AND e.a <> e.b) SELECT 'N' || a AS node, 'N' || b AS ancestor FROM c""")
def cyclic_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(F.lit("x").alias("kg"), F.concat(F.lit("N"), key).alias("child"), F.concat(F.lit("N"), (key * 3 + 1) % 25).alias("parent"))
    return hierarchy.ancestor_closure(edges).select("node", "ancestor")


@query(_sql(_A, _CLOSURE, out="SELECT kg, etype, CAST(layer AS INTEGER) AS layer FROM layers"))
def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.layers(*_parts(balances(spark, sf_dir)))


@query(_sql(_B, _CLOSURE, out="SELECT kg, etype, CAST(layer AS INTEGER) AS layer FROM layers"))
def layers_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.layers(*_parts(customers(spark, sf_dir)))


@query(_sql(_A, _CLOSURE, out="SELECT kg, etype, CAST(layer AS INTEGER) AS layer FROM layers"))
def layers_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, edges = _parts(balances(spark, sf_dir))
    return hierarchy.layers_in_order(own.withColumn("at", F.concat("etype", "property")), edges.withColumn("at", F.col("child")), "at")


@query("""SELECT 'x' AS kg, 'N' || n_nationkey AS etype, CASE WHEN n_nationkey = 0 THEN 1 WHEN n_nationkey < 5 THEN CAST(n_nationkey + 1 AS INTEGER) WHEN n_nationkey % 5 = 0 THEN 2 ELSE CAST(n_nationkey % 5 + 2 AS INTEGER) END AS layer FROM nation""")
def layers_of_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations hang on the one before them in their five, and, listed first, on N0: the later parent in the queue decides."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).where("k > 0")
    name = lambda c: F.concat(F.lit("N"), c.cast("string"))
    direct = n.select(name(F.col("k")).alias("child"), F.lit("N0").alias("parent"), F.format_string("a%03d", "k").alias("at"))
    chain = n.where("k % 5 > 0 and k > 5 or k between 2 and 4").select(name(F.col("k")).alias("child"), name(F.col("k") - 1).alias("parent"), F.format_string("b%03d", "k").alias("at"))
    own = n.limit(1).select(F.lit("x").alias("kg"), F.lit("N0").alias("etype"), F.lit("p").alias("property"), F.lit("0").alias("at"))
    return hierarchy.layers_in_order(own, direct.unionByName(chain).select(F.lit("x").alias("kg"), "*"), "at")


@query(f"""WITH RECURSIVE nations AS (SELECT 'N' || n_nationkey AS etype, n_nationkey, row_number() OVER (ORDER BY n_nationkey * 7 % 25) AS r FROM nation), turn AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY r, c_custkey) AS r FROM customer JOIN nations ON c_nationkey = n_nationkey),
depth AS (SELECT k, r, 2 AS d FROM turn WHERE k % 5 = 0 OR r < coalesce((SELECT r FROM turn x WHERE x.k = turn.k - 1), r + 1) UNION ALL SELECT t.k, t.r, d.d + 1 FROM depth d JOIN turn t ON t.k = d.k + 1 AND t.k % 5 > 0 AND t.r > d.r)
SELECT 'x' AS kg, etype, CAST(1 AS INTEGER) AS layer FROM nations UNION ALL SELECT 'x', 'C' || t.k, CAST(CASE WHEN t.k % 5 = 0 OR p.k IS NULL THEN 2 ELSE p.d + 1 END AS INTEGER) FROM turn t LEFT JOIN depth p ON p.k = t.k - 1""")
def layers_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers hang on their nation and, listed later, on the customer before them in their five, who may be served before or after them."""
    people, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    key = F.col("c_custkey")
    direct = people.select(name("C", key).alias("child"), name("N", F.col("c_nationkey")).alias("parent"), F.struct(F.lit(1).alias("list"), key.cast("long").alias("row")).alias("at"))
    before = people.select((key + 1).alias("next")).join(people, F.col("next") == key).where(key % 5 > 0)
    chain = before.select(name("C", key).alias("child"), name("C", key - 1).alias("parent"), F.struct(F.lit(2).alias("list"), key.cast("long").alias("row")).alias("at"))
    own = nation.select(F.lit("x").alias("kg"), name("N", F.col("n_nationkey")).alias("etype"), F.lit("p").alias("property"), F.struct(F.lit(0).alias("list"), (F.col("n_nationkey") * 7 % 25).cast("long").alias("row")).alias("at"))
    return hierarchy.layers_in_order(own, direct.unionByName(chain).select(F.lit("x").alias("kg"), "*"), "at")


@query(
    _sql(_A, _CLOSURE, out="""
, names AS (SELECT kg, etype FROM ep UNION SELECT kg, child FROM edges UNION SELECT kg, parent FROM edges)
SELECT n.kg, n.etype, (SELECT string_agg(DISTINCT parent, ',' ORDER BY parent) FROM edges e WHERE e.kg = n.kg AND child = n.etype) AS super_classes, (SELECT string_agg(DISTINCT child, ',' ORDER BY child) FROM edges e WHERE e.kg = n.kg AND parent = n.etype) AS sub_classes,
(SELECT string_agg(ancestor, ',' ORDER BY ancestor) FROM closure c WHERE c.kg = n.kg AND node = n.etype) AS path, (SELECT string_agg(node, ',' ORDER BY node) FROM closure c WHERE c.kg = n.kg AND ancestor = n.etype) AS all_sub_classes, CAST(coalesce(layer, 1) AS INTEGER) AS layer, 'class' AS type FROM names n LEFT JOIN layers l ON l.kg = n.kg AND l.etype = n.etype""")
)
def hierarchy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = EtypeEngine(spark).hierarchy(balances(spark, sf_dir))
    return out.select(*(F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in out.dtypes))


# ---- contexts


@query(_sql(_A, out="SELECT kg, etype, property, count(*) AS cnt FROM (SELECT DISTINCT kg, etype, property FROM ep) GROUP BY ALL"))
def count_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.token_counts(context.property_words(hierarchy.etype_properties(balances(spark, sf_dir))))


@query(_sql(_A, out="SELECT kg, etype, count(DISTINCT property) AS n_property FROM ep GROUP BY ALL"))
def n_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.property_counts(context.property_words(hierarchy.etype_properties(balances(spark, sf_dir))))


@query(_sql(_A, _CLOSURE, _FCA, out="SELECT kg, etype, CAST(layer AS INTEGER) AS layer, CAST(n_property AS INTEGER) AS n_property, appended FROM meta"))
def context_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(balances(spark, sf_dir)).meta


@query(_sql(_A, _CLOSURE, _FCA, out="SELECT kg, etype FROM meta WHERE appended"))
def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(balances(spark, sf_dir)).meta.where("appended").select("kg", "etype")


@query(_sql(_A, _CLOSURE, _FCA, out="SELECT kg, etype, property, v FROM fca"))
def fca_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.dense(_context(balances(spark, sf_dir))).select("kg", "etype", "property", "v")


@query(_sql(_A, _CLOSURE, _FCA, out="SELECT f.kg, f.etype, f.property, CAST(CASE WHEN v < 0 THEN -1 ELSE v END AS INTEGER) AS v FROM fca f"))
def fca_v_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.dense(_context(balances(spark, sf_dir), weight_tag=False)).select("kg", "etype", "property", "v")


@query(_sql(_A, _CLOSURE, _FCA, out="SELECT t.kg, t.etype, p.property, coalesce(w.w, -1) AS v FROM types t JOIN (SELECT DISTINCT kg, property FROM ep) p ON p.kg = t.kg LEFT JOIN w ON w.kg = t.kg AND w.etype = t.etype AND w.property = p.property"))
def fca_v_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, edges = _parts(balances(spark, sf_dir))
    return context.flat(own, hierarchy.layers(own, edges))


@query(_sql(_A, _CLOSURE, _FCA, out="SELECT kg, etype, property, CASE WHEN h < 0 THEN -1 ELSE h END AS h FROM fca"))
def fca_h_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.dense(_context(balances(spark, sf_dir)), weight_tag=False).select("kg", "etype", "property", F.col("h").cast("int").alias("h"))


@query(_sql(_A, _CLOSURE, _FCA, out="SELECT kg, etype, property, h FROM fca"))
def fca_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.dense(_context(balances(spark, sf_dir))).select("kg", "etype", "property", F.col("h").cast("int").alias("h"))


@query(_sql(_A, _CLOSURE, _FCA, out="SELECT kg, etype, property, round(CAST(i AS DOUBLE), 6) + 0.0 AS i FROM fca"))
def fca_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.dense(_context(balances(spark, sf_dir))).select("kg", "etype", "property", "i"), "i")


@query(_sql(_B, _CLOSURE, _FCA, out="SELECT kg, etype, property, v, h, round(CAST(i AS DOUBLE), 6) + 0.0 AS i FROM fca"))
def fca_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.dense(_context(customers(spark, sf_dir))), "i").withColumn("h", F.col("h").cast("int"))


_WIDE = [f"b{i}" for i in range(BUCKETS)]


@query(_sql(_A, _CLOSURE, _FCA, out=f"SELECT etype, {', '.join(_WIDE)} FROM (PIVOT (SELECT etype, property, v FROM fca WHERE kg = 'A1') ON property IN ({', '.join(repr(b) for b in _WIDE)}) USING first(v))"))
def fca_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context.wide(context.dense(_context(balances(spark, sf_dir))).where("kg = 'A1'"), "v")
    return out.select("etype", *(F.col(c) if c in out.columns else F.lit(None).cast("int").alias(c) for c in _WIDE))


@query(_sql(_A, _CLOSURE, _FCA, out="SELECT kg, property, CAST(n AS INTEGER) AS n, round(CAST(ig AS DOUBLE), 6) + 0.0 AS ig FROM ig"))
def info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_context(balances(spark, sf_dir)).by_property.select("kg", "property", "n", "ig"), "ig")


@query(
    """WITH h AS (SELECT round_even(-sum(p * log2(p)), 3) AS a FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)),
l AS (SELECT u, sum(k) AS k, round_even(-sum(k / t * log2(k / t)), 3) AS e FROM (SELECT user_id % 7 AS u, count(*) AS k, sum(count(*)) OVER (PARTITION BY user_id % 7) AS t FROM events GROUP BY user_id % 7, event_type) GROUP BY u)
SELECT round(CAST(max(a) - sum(e * round_even(k / (SELECT count(*) FROM events), 3)) AS DOUBLE), 6) + 0.0 AS gain FROM l, h"""
)
def info_gain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("u"))
    return rounded(context.information_gain(events, "event_type", "u", "entropy"), "gain")


@query("""SELECT CAST(round_even(-sum(p * log2(p)), 3) AS DOUBLE) AS impurity FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)""")
def impurity_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.impurity(table(spark, sf_dir, "events"), [], "event_type", "entropy")


@query("""SELECT CAST(round_even(1 - sum(p * p), 3) AS DOUBLE) AS impurity FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)""")
def impurity_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.impurity(table(spark, sf_dir, "events"), [], "event_type", "gini")


# ---- pairs


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct()


def _named_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names as two ontologies, P and Q, and the names of both that correspond (those that begin with a, b or c)."""
    names = _part_names(spark, sf_dir)
    both = names.select(F.explode(F.array(F.lit("P"), F.lit("Q"))).alias("kg"), F.col("p_name").alias("name"))
    ends = F.explode(F.array(F.struct(F.lit("P").alias("kg1"), F.lit("Q").alias("kg2")))).alias("ends")  # rows, as from a file; a join on literals would be planned as a product
    truth = names.where(F.left("p_name", F.lit(1)).isin("a", "b", "c")).select(ends, "p_name").select("ends.kg1", "ends.kg2", F.col("p_name").alias("e1"), F.col("p_name").alias("e2"))
    return both, truth


_NAMES = "WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name FROM n WHERE left(p_name, 1) IN ('a', 'b', 'c'))"


@query(f"{_NAMES} SELECT 'P' AS kg1, 'Q' AS kg2, a.p_name AS label1, b.p_name AS label2 FROM n a, n b WHERE EXISTS (SELECT 1 FROM t)")
def etype_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, truth = _named_parts(spark, sf_dir)
    return pairs._grid(names, names, truth)


@query(f"{_NAMES} SELECT 'P' AS kg1, 'Q' AS kg2, a.p_name AS label1, b.p_name AS label2, CAST(a.p_name = b.p_name AND a.p_name IN (SELECT p_name FROM t) AS INTEGER) AS match, 'Etype' AS type FROM n a, n b WHERE EXISTS (SELECT 1 FROM t)")
def etype_pairs_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, truth = _named_parts(spark, sf_dir)
    return pairs.labelled(pairs._grid(names, names, truth), truth, "Etype")


@query(f"{_NAMES} SELECT 'P' AS kg1, 'Q' AS kg2, p_name AS label1, p_name AS label2, 1 AS match, 'Etype' AS type FROM t, range(2)")
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, truth = _named_parts(spark, sf_dir)
    return pairs.etype_pairs(names, truth, 4).where("match = 1")


#: The walk of `pairs.sample_unmatched` over part names for seed 42, and 8 others for each match: starts and steps are 32-bit parts of the count of pairs.
_PART = [(k * pairs.GOLDEN % (1 << 64)) >> 32 for k in (44, 43)]
_OTHERS = f"""{_NAMES}, i AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS pos FROM n), hit AS (SELECT pos * (SELECT count(*) FROM n) + pos AS x FROM i JOIN t USING (p_name)), d AS (SELECT count(*) AS side, CAST(count(*) * count(*) AS HUGEINT) AS size, (SELECT count(*) FROM t) AS m FROM n),
walk AS (SELECT *, (size * {_PART[0]}) >> 32 AS start, list_filter(range(CAST((size * {_PART[1]}) >> 32 AS BIGINT), CAST(size + 2 AS BIGINT)), lambda s: s > 0 AND gcd(s, CAST(size AS BIGINT)) = 1)[1] AS step FROM d),
drawn AS (SELECT CAST((start + t * CAST(step AS HUGEINT)) % size AS BIGINT) AS x, row_number() OVER (ORDER BY t) AS r, side, m FROM walk, range(9 * m) s(t) WHERE (start + t * CAST(step AS HUGEINT)) % size NOT IN (SELECT x FROM hit)),
neg AS (SELECT a.p_name AS label1, b.p_name AS label2 FROM drawn JOIN i a ON a.pos = x // side JOIN i b ON b.pos = x % side WHERE r <= 8 * m)"""


@query(f"""{_OTHERS} SELECT 'P' AS kg1, 'Q' AS kg2, label1, label2, 0 AS match, 'Etype' AS type FROM neg""")
def negative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, truth = _named_parts(spark, sf_dir)
    return pairs.etype_pairs(names, truth, 4).where("match = 0")


@query(_sql(_A, out="SELECT 'A1' AS kg1, 'A2' AS kg2, a.property AS label1, b.property AS label2, -1 AS match, 'Property' AS type FROM (SELECT DISTINCT property FROM ep WHERE kg = 'A1') a, (SELECT DISTINCT property FROM ep WHERE kg = 'A2') b"))
def property_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hierarchy.etype_properties(balances(spark, sf_dir)).select("kg", F.col("property").alias("name")).distinct()
    return pairs.property_pairs(own, alignment(spark, sf_dir), blind=True)


@query(
    _sql(_A, out="""
, a AS (SELECT property AS label1, row_number() OVER (ORDER BY property) - 1 AS pos FROM (SELECT DISTINCT property FROM ep WHERE kg = 'A1')), b AS (SELECT property AS label2, row_number() OVER (ORDER BY property) - 1 AS pos FROM (SELECT DISTINCT property FROM ep WHERE kg = 'A2')),
known AS (SELECT label1, label2, a.pos * (SELECT count(*) FROM b) + b.pos AS x FROM a JOIN b ON label1 = replace(label2, 'B_', 'b')),
d AS (SELECT (SELECT count(*) FROM b) AS side, CAST((SELECT count(*) FROM a) * (SELECT count(*) FROM b) AS HUGEINT) AS size, (SELECT count(*) FROM known) AS m),
walk AS (SELECT *, (size * """ + str((44 * pairs.GOLDEN % (1 << 64)) >> 32) + """) >> 32 AS start, list_filter(range(CAST((size * """ + str((43 * pairs.GOLDEN % (1 << 64)) >> 32) + """) >> 32 AS BIGINT), CAST(size + 2 AS BIGINT)), lambda s: s > 0 AND gcd(s, CAST(size AS BIGINT)) = 1)[1] AS step FROM d),
drawn AS (SELECT CAST((start + t * CAST(step AS HUGEINT)) % size AS BIGINT) AS x, row_number() OVER (ORDER BY t) AS r, side, m FROM walk, range(3 * m) s(t) WHERE (start + t * CAST(step AS HUGEINT)) % size NOT IN (SELECT x FROM known))
SELECT 'A1' AS kg1, 'A2' AS kg2, label1, label2, 1 AS match, 'Property' AS type FROM known UNION ALL SELECT 'A1', 'A2', a.label1, b.label2, 0, 'Property' FROM drawn JOIN a ON a.pos = x // side JOIN b ON b.pos = x % side WHERE r <= 2 * m""")
)
def property_pairs_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hierarchy.etype_properties(balances(spark, sf_dir)).select("kg", F.col("property").alias("name")).distinct()
    truth = own.where("kg = 'A1'").select(F.lit("A1").alias("kg1"), F.lit("A2").alias("kg2"), F.col("name").alias("e1"), F.replace("name", F.lit("b"), F.lit("B_")).alias("e2"))
    return pairs.property_pairs(own, truth, blind=False, m_factor=2)


@query(f"""{_OTHERS} SELECT 'P' AS kg1, 'Q' AS kg2, label1, label2, 0 AS match, 'Etype' AS type FROM neg UNION ALL SELECT 'P', 'Q', p_name, p_name, 1, 'Etype' FROM t, range(2) UNION ALL SELECT 'P', 'Q', a.p_brand, b.p_brand, -1, 'Property' FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT DISTINCT p_brand FROM part) b""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, truth = _named_parts(spark, sf_dir)
    brands = table(spark, sf_dir, "part").select(F.explode(F.array(F.lit("P"), F.lit("Q"))).alias("kg"), F.col("p_brand").alias("name")).distinct()
    return pairs.candidate_pairs(names, brands, truth, blind=True, m_factor=4)


def _mapped(spark: SparkSession, triples: DataFrame, sf_dir: str) -> DataFrame:
    own = hierarchy.etype_properties(triples).select("kg", F.col("property").alias("name")).distinct()
    return pairs.property_map(own, alignment(spark, sf_dir))


@query(_sql(_A, out=", a AS (SELECT DISTINCT property, lower(regexp_replace(property, '[^A-Za-z0-9]', '', 'g')) AS k, kg FROM ep) SELECT 'A1' AS kg1, 'A2' AS kg2, x.property AS p1, max(y.property) AS p2 FROM a x JOIN a y ON x.k = y.k AND x.kg = 'A1' AND y.kg = 'A2' GROUP BY x.property"))
def property_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, balances(spark, sf_dir), sf_dir)


@query(_sql(_A, out="SELECT 'A1' AS kg1, 'A2' AS kg2, a.property AS p1, max(b.property) AS p2 FROM (SELECT DISTINCT property FROM ep WHERE kg = 'A1') a JOIN (SELECT DISTINCT property FROM ep WHERE kg = 'A2') b ON replace(b.property, 'B_', 'b') = a.property GROUP BY a.property"))
def property_map_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hierarchy.etype_properties(balances(spark, sf_dir)).select("kg", F.col("property").alias("name")).distinct()
    truth = own.where("kg = 'A1'").select(F.lit("A1").alias("kg1"), F.lit("A2").alias("kg2"), F.col("name").alias("e1"), F.replace("name", F.lit("b"), F.lit("B_")).alias("e2"))
    return pairs.property_map(own, alignment(spark, sf_dir), truth)


# ---- similarities of names


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, truth = _named_parts(spark, sf_dir)
    return pairs._grid(names, names, truth).select("label1", "label2")


@query(f"{_NAMES}, p AS (SELECT a.p_name AS label1, b.p_name AS label2, list_sum(list_transform(list_distinct(string_split(a.p_name, '')), lambda c: CAST(least(length(a.p_name) - length(replace(a.p_name, c, '')), length(b.p_name) - length(replace(b.p_name, c, ''))) AS BIGINT))) AS s FROM n a, n b) SELECT label1, label2, round(s / (length(label1) + length(label2) - s), 6) AS sim FROM p")
def sim_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_name_pairs(spark, sf_dir).select("label1", "label2", similarity.ngram1(F.col("label1"), F.col("label2")).alias("sim")), "sim")


@query(f"{_NAMES} SELECT a.p_name AS label1, b.p_name AS label2, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS sim FROM n a, n b")
def sim_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_name_pairs(spark, sf_dir).select("label1", "label2", similarity.levenshtein(F.col("label1"), F.col("label2")).alias("sim")), "sim")


@query(f"""WITH RECURSIVE{_NAMES.removeprefix("WITH")}, p AS (SELECT a.p_name AS label1, b.p_name AS label2, string_split(a.p_name, '') AS x, string_split(b.p_name, '') AS y FROM n a, n b WHERE EXISTS (SELECT 1 FROM t)),
step AS (SELECT label1, label2, x, y, 0 AS i, list_transform(range(len(y) + 1), lambda z: CAST(0 AS BIGINT)) AS r FROM p UNION ALL SELECT label1, label2, x, y, i + 1, list_reduce(range(1, len(y) + 1), lambda own, j: list_append(own, greatest(own[-1], r[j + 1], r[j] + CASE WHEN x[i + 1] = y[j] THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]) FROM step WHERE i < len(x))
SELECT label1, label2, round(2.0 * r[-1] / (len(x) + len(y)), 6) AS sim FROM step WHERE i = len(x)""")
def sim_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_name_pairs(spark, sf_dir).select("label1", "label2", similarity.longest_common(F.col("label1"), F.col("label2")).alias("sim")), "sim")


@query(f"""{_NAMES}, s AS (SELECT DISTINCT p_name, p_name[i:j] AS x FROM n, range(1, 60) r(i), range(1, 60) q(j) WHERE i <= j AND j <= length(p_name)), m AS (SELECT a.p_name AS label1, b.p_name AS label2, max(length(a.x)) AS k FROM s a JOIN s b ON a.x = b.x GROUP BY ALL)
SELECT a.p_name AS label1, b.p_name AS label2, round(2 * coalesce(k, 0) / (length(a.p_name) + length(b.p_name)), 6) AS sim FROM n a CROSS JOIN n b LEFT JOIN m ON label1 = a.p_name AND label2 = b.p_name""")
def sim_lcs_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_name_pairs(spark, sf_dir).select("label1", "label2", similarity.longest_common(F.col("label1"), F.col("label2"), substring=True).alias("sim")), "sim")


@query("""WITH w AS (SELECT CAST(embedding AS DOUBLE[]) AS e, label, vec_id // 20 AS k FROM embeddings) SELECT 'L' || a.label AS label1, 'L' || b.label AS label2, round(greatest(0, max(list_cosine_similarity(a.e, b.e))), 6) AS sim FROM w a JOIN w b USING (k) GROUP BY a.label, b.label""")
def sim_word2vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    vectors = own.select(F.concat(F.lit("v"), "vec_id").alias("word"), "embedding")
    one = own.select(F.floor(F.col("vec_id") / 20).alias("k"), F.concat(F.lit("L"), "label").alias("label"), F.concat(F.lit("v"), "vec_id").alias("w"))  # twenty words a name
    words = one.select("k", F.col("label").alias("label1"), F.col("w").alias("w1")).join(one.select("k", F.col("label").alias("label2"), F.col("w").alias("w2")), "k").drop("k")
    return rounded(lexical.vector_similarity(words, vectors), "sim")


_TREE = """WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'R' || r_regionkey, 'root' FROM region),
up AS (SELECT child AS node, parent AS anc FROM e UNION SELECT up.node, e.parent FROM up JOIN e ON up.anc = e.child), nodes AS (SELECT child AS node FROM e UNION SELECT parent FROM e),
d AS (SELECT node, 1 + (SELECT count(*) FROM up WHERE up.node = nodes.node) AS depth FROM nodes), self AS (SELECT * FROM up UNION SELECT node, node FROM nodes)"""


@query(f"""{_TREE}, p AS (SELECT x.node AS a, y.node AS b, max(d.depth) AS k FROM self x JOIN self y ON x.anc = y.anc JOIN d ON d.node = x.anc WHERE x.node LIKE 'C%' AND y.node LIKE 'N%' GROUP BY ALL) SELECT a, b, round(2.0 * k / (p1.depth + p2.depth), 6) AS wup FROM p JOIN d p1 ON p1.node = a JOIN d p2 ON p2.node = b""")
def sim_wup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    people, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    tree = nation.select(name("N", "n_nationkey").alias("child"), name("R", "n_regionkey").alias("parent"))
    tree = tree.unionByName(people.select(name("C", "c_custkey").alias("child"), name("N", "c_nationkey").alias("parent")))
    tree = tree.unionByName(table(spark, sf_dir, "region").select(name("R", "r_regionkey").alias("child"), F.lit("root").alias("parent")))
    dealt = people.select(name("C", "c_custkey").alias("a")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a")  # a task of the scan would make 25 times its rows
    both = dealt.crossJoin(F.broadcast(nation.select(name("N", "n_nationkey").alias("b"))))  # 25 nations
    return rounded(lexical.wu_palmer(both, tree), "wup")


#: A graph of senses: customers under their nation and another one, some under the top itself; nations under their region and, some, under the next; one region under another.
_SENSES = """WITH RECURSIVE e AS (SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer UNION SELECT 'C' || c_custkey, 'N' || (c_nationkey * 3 + c_custkey) % 25 FROM customer UNION SELECT 'C' || c_custkey, 'top' FROM customer WHERE c_custkey % 7 = 0
  UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'N' || n_nationkey, 'R' || (n_regionkey + 1) % 5 FROM nation WHERE n_nationkey % 4 = 0 UNION SELECT 'R' || r_regionkey, CASE WHEN r_regionkey = 4 THEN 'R2' ELSE 'top' END FROM region),
ways AS (SELECT child AS node, parent AS anc, 1 AS d FROM e UNION SELECT w.node, e.parent, w.d + 1 FROM ways w JOIN e ON w.anc = e.child), nodes AS (SELECT child AS node FROM e UNION SELECT parent FROM e),
up AS (SELECT node, anc, min(d) AS least, max(d) AS most FROM (SELECT * FROM ways UNION ALL SELECT node, node, 0 FROM nodes) GROUP BY ALL), deep AS (SELECT node, least, most FROM up WHERE anc = 'top'),
synsets AS (SELECT lower(c_name) AS word, 'C' || c_custkey AS synset FROM customer UNION SELECT lower(c_name), 'N' || (c_custkey * 7) % 25 FROM customer UNION SELECT lower(r_name), 'R' || r_regionkey FROM region UNION SELECT lower(r_name), 'N' || (r_regionkey * 5 + 2) FROM region),
pr AS (SELECT c_name AS label1, r_name AS label2, a.synset AS a, b.synset AS b FROM customer, region, synsets a, synsets b WHERE a.word = lower(c_name) AND b.word = lower(r_name)),
ab AS (SELECT DISTINCT a, b FROM pr),
met AS (SELECT a, b, d.node AS top, most + 1 AS d FROM ab JOIN (SELECT node, anc FROM up) x ON x.node = a JOIN (SELECT node, anc FROM up) y ON y.node = b AND y.anc = x.anc JOIN deep d ON d.node = x.anc QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY least DESC, top <> a, top) = 1),
steps AS (SELECT x.node, y.node AS top, min(x.least + y.least) AS s FROM up x JOIN up y ON x.anc = y.anc WHERE (x.node, y.node) IN (SELECT (a, top) FROM met UNION SELECT (b, top) FROM met) GROUP BY x.node, y.node),
wup AS (SELECT m.a, m.b, 2.0 * d / (2 * d + p.s + q.s) AS wup FROM met m JOIN steps p ON p.node = m.a AND p.top = m.top JOIN steps q ON q.node = m.b AND q.top = m.top)"""


def _senses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(word, synset) and (child, parent)."""
    people, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    name = lambda p, c: F.concat(F.lit(p), (F.col(c) if isinstance(c, str) else c).cast("string"))
    key, home = F.col("c_custkey"), F.col("c_nationkey")
    edge = lambda df, child, parent: df.select(child.alias("child"), parent.alias("parent"))
    edges = [
        edge(people, name("C", key), name("N", home)),
        edge(people, name("C", key), name("N", (home * 3 + key) % 25)),
        edge(people.where(key % 7 == 0), name("C", key), F.lit("top")),
        edge(nation, name("N", "n_nationkey"), name("R", "n_regionkey")),
        edge(nation.where("n_nationkey % 4 = 0"), name("N", "n_nationkey"), name("R", (F.col("n_regionkey") + 1) % 5)),
        edge(region, name("R", "r_regionkey"), F.when(F.col("r_regionkey") == 4, F.lit("R2")).otherwise(F.lit("top"))),
    ]
    sense = lambda df, word, synset: df.select(F.lower(word).alias("word"), synset.alias("synset"))
    senses = [sense(people, "c_name", name("C", key)), sense(people, "c_name", name("N", key * 7 % 25)), sense(region, "r_name", name("R", "r_regionkey")), sense(region, "r_name", name("N", F.col("r_regionkey") * 5 + 2))]
    return reduce(DataFrame.unionByName, senses).distinct(), reduce(DataFrame.unionByName, edges).distinct()


@query(f"{_SENSES} SELECT label1, label2, round(max(wup), 6) AS sim FROM pr JOIN wup USING (a, b) GROUP BY ALL")
def sim_wordnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    synsets, hypernyms = _senses(spark, sf_dir)
    both = table(spark, sf_dir, "customer").select(F.col("c_name").alias("label1")).crossJoin(F.broadcast(table(spark, sf_dir, "region").select(F.col("r_name").alias("label2"))))  # five regions
    words = both.select("label1", "label2", F.lower("label1").alias("w1"), F.lower("label2").alias("w2"))
    return rounded(lexical.synset_similarity(words, synsets, hypernyms), "sim")


@query(f"{_SENSES} SELECT node, CAST(least AS INTEGER) AS least, CAST(most AS INTEGER) AS most FROM deep")
def sense_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.depths(_senses(spark, sf_dir)[1])


# ---- files and blank nodes


@query("SELECT 'v' || vec_id AS word, len(embedding) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS norm FROM embeddings")
def vectors_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written in the binary form and read back."""
    path = f"{shared_dir(spark)}/kindred/vectors-{uuid.uuid4().hex}"
    files.write_vectors_binary(table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("word"), "embedding"), path)
    e = F.col("embedding")
    norm = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rounded(files.read_vectors_binary(spark, path).select("word", F.size(e).cast("long").alias("width"), e[0].alias("first"), norm.alias("norm")), "first", "norm")


@query(f"WITH {_A} SELECT kg, property AS subject_term, 'domain' AS predicate_term, etype AS object_term FROM ep UNION ALL SELECT kg, child, 'subClassOf', parent FROM edges UNION ALL SELECT kg, etype, 'type', 'Class' FROM declared")
def spreadsheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written to spreadsheets and read back."""
    path = f"{shared_dir(spark)}/kindred/sheets-{uuid.uuid4().hex}"
    ontology.export_sheets(balances(spark, sf_dir), path, datetime.date(2024, 1, 1))
    return ontology.read_sheets(spark, path).select("kg", "subject_term", "predicate_term", "object_term")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph: properties whose domain is a list of customers, in turn named and the class of a restriction, and, where there are several lists a nation, as range a list of those lists."""
    number = F.row_number().over(Window.partitionBy("c_nationkey", "block").orderBy("c_custkey"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_custkey") / 1000).alias("block")).withColumn("k", number)
    joined = lambda *parts: F.concat(*(F.lit(p) if p.startswith(("_:", "x#", "_")) else F.col(p).cast("string") for p in parts))
    people = people.withColumn("list", joined("c_nationkey", "_", "block")).withColumn("up", F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "block").orderBy("c_custkey")))
    blocks = people.select("list", "c_nationkey", "block").distinct()
    blocks = blocks.withColumn("up", F.lead("list").over(Window.partitionBy("c_nationkey").orderBy("block"))).withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("block")))
    odd = people.where("k % 2 = 1")
    nil = F.lit("x#nil")
    rows = [
        (blocks, joined("x#p", "list"), "domain", joined("_:d", "list")),
        (people.where("k = 1"), joined("_:d", "list"), "unionOf", joined("_:c", "c_custkey")),
        (people, joined("_:c", "c_custkey"), "first", F.when(F.col("k") % 2 == 1, joined("_:r", "c_custkey")).otherwise(joined("x#C", "c_custkey"))),
        (people, joined("_:c", "c_custkey"), "rest", F.coalesce(joined("_:c", "up"), nil)),
        (odd, joined("_:r", "c_custkey"), "someValuesFrom", joined("x#C", "c_custkey")),
        (blocks.where("k = 1"), joined("x#n", "c_nationkey"), "range", joined("_:n", "c_nationkey")),
        (blocks.where("k = 1"), joined("_:n", "c_nationkey"), "intersectionOf", joined("_:b", "list")),
        (blocks, joined("_:b", "list"), "first", joined("_:d", "list")),
        (blocks, joined("_:b", "list"), "rest", F.coalesce(joined("_:b", "up"), nil)),
    ]
    kind = F.when(F.startswith("object", F.lit("_:")), "bnode").otherwise("iri")
    made = [df.select(F.lit("C").alias("kg"), s.alias("subject"), F.lit(f"x#{p}").alias("predicate"), o.alias("object")) for df, s, p, o in rows]
    return reduce(DataFrame.unionByName, made).withColumn("object_kind", kind)


@query("""SELECT 'p' || c_nationkey || '_' || c_custkey // 1000 AS subject_term, 'domain' AS predicate_term, string_agg('C' || c_custkey, '|' ORDER BY c_custkey) AS object_term FROM customer GROUP BY c_nationkey, c_custkey // 1000
UNION ALL SELECT 'n' || c_nationkey, 'range', string_agg('C' || c_custkey, '|' ORDER BY c_custkey) FROM customer GROUP BY c_nationkey""")
def class_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank nodes of lists in restrictions in lists, as the classes that they name."""
    graph = written(_nested(spark, sf_dir), "graph")
    return ontology.triples(graph, coded=False).where("predicate_term in ('domain', 'range')").select("subject_term", "predicate_term", "object_term")


# ---- property similarities


def _raw(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    triples = balances(spark, sf_dir)
    c = _context(triples)
    a, b = _one(c, "A1"), _one(c, "A2")
    grid = pairs._grid(c.meta.select("kg", F.col("etype").alias("name")), c.meta.select("kg", F.col("etype").alias("name")), alignment(spark, sf_dir))
    return grid, scores.raw_scores(grid, a, b, _mapped(spark, triples, sf_dir), **options)


def _raw_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _raw(spark, sf_dir)[1].select(*scores.PAIR, (F.col(f"raw_{name}") + 1e-9).alias(f"raw_{name}"))  # off the halves, where sums in another order round apart
        return rounded(out, f"raw_{name}")

    run.__name__ = f"sim_{name}_raw"
    query(_sql(_A, _CLOSURE, _FCA, _SCORES, out=f"SELECT kg1, kg2, label1, label2, round(raw_{name} + 1e-9, 6) + 0.0 AS raw_{name} FROM raw"))(run)


def _sim_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid, raw = _raw(spark, sf_dir)
        return rounded(scores.similarities(grid, raw).select(*scores.PAIR, (F.col(f"sim_{name}") + 1e-9).alias(f"sim_{name}")), f"sim_{name}")

    run.__name__ = f"sim_{name}"
    query(_sql(_A, _CLOSURE, _FCA, _SCORES, out=f"SELECT kg1, kg2, label1, label2, round(CAST(sim_{name} AS DOUBLE) + 1e-9, 6) + 0.0 AS sim_{name} FROM sims"))(run)


for _name in "vhi":
    _raw_query(_name)
    _sim_query(_name)


@query("""SELECT s_suppkey, round((s_acctbal - a) / (b - a), 6) + 0.0 AS x FROM supplier, (SELECT min(s_acctbal) AS a, max(s_acctbal) AS b FROM supplier)""")
def norm_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.lit(1).alias("g"))
    return rounded(similarity.minmax(own, "x", ["g"]).drop("g"), "x")


@query("""SELECT s_suppkey, round(greatest(0, least(1, (s_acctbal - a) / b)), 6) + 0.0 AS x FROM supplier, (SELECT avg(s_acctbal) AS a, stddev_pop(s_acctbal) AS b FROM supplier)""")
def norm_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.lit(1).alias("g"))
    return rounded(similarity.zscore(own, "x", ["g"]).drop("g"), "x")


@query("""SELECT s_suppkey, round(1 / (1 + exp(-s_acctbal / 1000)), 6) AS x FROM supplier""")
def norm_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "supplier").select("s_suppkey", similarity.sigmoid(F.col("s_acctbal") / 1000).alias("x")), "x")


@query("""SELECT s_suppkey, round(ln(b) / ln(s_acctbal + 2000), 6) AS x FROM supplier, (SELECT max(s_acctbal) + 2000 AS b FROM supplier)""")
def norm_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") + 2000).alias("x"))
    top = own.agg(F.max("x").alias("top"))
    return rounded(own.crossJoin(F.broadcast(top)).select("s_suppkey", similarity.log_ratio(F.col("x"), F.col("top")).alias("x")), "x")  # one row


# ---- learning

_MEASURES = """c AS (SELECT {keys} CAST(count_if(quality = 1 AND toxic = 1) AS DOUBLE) AS tp, CAST(count_if(toxic = 1) AS DOUBLE) AS np, CAST(count_if(quality = 1) AS DOUBLE) AS nt FROM m {group}),
r AS (SELECT *, tp / nullif(np, 0) AS p, tp / nullif(nt, 0) AS r FROM c)
SELECT {keys} CAST(tp AS BIGINT) AS tp, CAST(np AS BIGINT) AS n_pred, CAST(nt AS BIGINT) AS n_true, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1, round(1.25 * p * r / nullif(0.25 * p + r, 0), 6) AS f05, round(5 * p * r / nullif(4 * p + r, 0), 6) AS f2,
round(r, 6) AS swapped_precision, round(p, 6) AS swapped_recall, round(1.25 * p * r / nullif(1.25 * r + p, 0), 6) AS odd_f05, round(5 * p * r / nullif(5 * r + p, 0), 6) AS odd_f2 FROM r"""
_MEASURED = ("precision", "recall", "f1", "f05", "f2", "swapped_precision", "swapped_recall", "odd_f05", "odd_f2")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("match"), F.col("toxic").alias("predict"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query("WITH m AS (SELECT * FROM labels JOIN documents USING (doc_id)), " + _MEASURES.format(keys="", group=""))
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.measures(_labelled(spark, sf_dir)), *_MEASURED)


@query("WITH m AS (SELECT * FROM labels JOIN documents USING (doc_id)), " + _MEASURES.format(keys="lang,", group="GROUP BY lang"))
def metrics_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.measures(_labelled(spark, sf_dir), ["lang"]), *_MEASURED)


@query("SELECT doc_id, lang, quality AS match, toxic AS predict FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND toxic = 1")
def correct_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.mappings(_labelled(spark, sf_dir))[2]


@query()
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _context(balances(spark, sf_dir))
    truth = alignment(spark, sf_dir)
    known = c.meta.where("not appended").select("kg", "etype")
    truth = truth.join(known.select(F.col("kg").alias("kg1"), F.col("etype").alias("e1")), ["kg1", "e1"]).join(known.select(F.col("kg").alias("kg2"), F.col("etype").alias("e2")), ["kg2", "e2"])
    return EtypeEngine(spark).match(_one(c, "A1"), _one(c, "A2"), truth.select("kg1", "kg2", "e1", "e2"), blind=True)


@query()
def train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EtypeEngine(spark).train(written(features(spark, sf_dir), "features"), "DecisionTree")
