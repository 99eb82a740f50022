"""The driver's star-schema tables seen as ontologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ranges of balances, from -1000 to 10000 by 500.
BUCKETS = 22


def _bucket(balance: str) -> Column:
    return F.floor((F.col(balance) + 1000) / 500).cast("string")


def _named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of two ontologies: A1, nations and the balances of their suppliers; A2, the balances that an even share or more of a nation's customers have.
    A region has what two nations of it share. Ports of A1, which have no property, are declared."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").select("c_nationkey", F.concat(F.lit("B_"), _bucket("c_acctbal")).alias("property"))
    people = customer.groupBy("c_nationkey").agg(F.count("*").alias("people"))
    often = customer.groupBy("c_nationkey", "property").agg(F.count("*").alias("k")).join(people, "c_nationkey").where(F.col("k") * BUCKETS >= F.col("people"))
    one = table(spark, sf_dir, "supplier").select(F.lit("A1").alias("kg"), F.col("s_nationkey").alias("nation"), F.concat(F.lit("b"), _bucket("s_acctbal")).alias("property"))
    two = often.select(F.lit("A2").alias("kg"), F.col("c_nationkey").alias("nation"), "property")
    own = one.unionByName(two).distinct()
    shared = own.join(nation, own["nation"] == nation["n_nationkey"]).groupBy("kg", "n_regionkey", "property").agg(F.count("*").alias("k")).where("k >= 2")
    typed = own.select("kg", "property", _named("N", "nation").alias("etype")).unionByName(shared.select("kg", "property", _named("R", "n_regionkey").alias("etype")))
    kgs = own.select("kg").distinct()
    ports = nation.where(F.length("n_name") > 6).select(F.lit("A1").alias("kg"), _named("P", "n_nationkey").alias("c"))
    return _triples(typed, kgs.crossJoin(F.broadcast(nation.select(_named("N", "n_nationkey").alias("child"), _named("R", "n_regionkey").alias("parent")))), ports)  # two rows by 25


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of one larger ontology, B: customers and the years and states of their orders; a nation has what 36 percent of its customers have."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("y"), F.year("o_orderdate").cast("string"), F.lit("_"), F.col("o_orderstatus")).alias("property")).distinct()
    own = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    people = customer.groupBy("c_nationkey").agg(F.count("*").alias("people"))
    shared = own.groupBy("c_nationkey", "property").agg(F.count("*").alias("k")).join(people, "c_nationkey").where(F.col("k") * 100 >= F.col("people") * 36)
    typed = own.select("property", _named("C", "c_custkey").alias("etype")).unionByName(shared.select("property", _named("N", "c_nationkey").alias("etype")))
    return _triples(typed.withColumn("kg", F.lit("B")), customer.select(F.lit("B").alias("kg"), _named("C", "c_custkey").alias("child"), _named("N", "c_nationkey").alias("parent")))


def _triples(typed: DataFrame, edges: DataFrame, more: DataFrame | None = None) -> DataFrame:
    def row(df: DataFrame, s: str, p: str, o: Column) -> DataFrame:
        return df.select("kg", F.concat(F.lit("http://example.org/"), F.col("kg"), F.lit("#"), F.col(s)).alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.col(s).alias("subject_term"), F.lit(p).alias("predicate_term"), o.alias("object_term"))

    classes = edges.select("kg", F.col("child").alias("c")).unionByName(edges.select("kg", F.col("parent").alias("c")))
    classes = (classes if more is None else classes.unionByName(more)).distinct()
    return row(typed, "property", "domain", F.col("etype")).unionByName(row(edges, "child", "subClassOf", F.col("parent"))).unionByName(row(classes, "c", "type", F.lit("Class")))


def alignment(spark: SparkSession, sf_dir: str, below: int = 15) -> DataFrame:
    """(kg1, kg2, e1, e2): the first nations of A1 and A2 correspond."""
    name = _named("N", "n_nationkey")
    return table(spark, sf_dir, "nation").where(F.col("n_nationkey") < below).select(F.lit("A1").alias("kg1"), F.lit("A2").alias("kg2"), name.alias("e1"), name.alias("e2"))
