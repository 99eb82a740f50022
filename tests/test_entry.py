import duckdb
import pytest

import __spark_entry__ as e
from kindred.plans import queries as own

SF = "/root/testdata/sf0.001"
FAST = ["local_name", "formal_label", "word_split", "etype_property", "fca_v", "fca_i", "sim_levenshtein", "sim_v", "property_map", "metrics", "sim_wordnet", "sense_depths", "layers_of_customers", "layers_of_dag", "negative_sample", "property_pairs_labeled", "vectors_binary", "spreadsheets", "class_expressions"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "pages", "labels", "documents", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({own.SQL[name]})").fetchall()
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    assert sorted(([plain(v) for v in r] for r in want), key=str) == sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)


def test_entry_and_names(spark):
    assert e.entry(spark).count() > 0
    assert set(own.SQL) <= set(own.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    mapped = plan(own.QUERIES["property_map"](spark, SF))
    assert "CartesianProduct" not in mapped and "Python" not in mapped
    assert "BatchEvalPython" not in plan(own.QUERIES["sim_lcs"](spark, SF))
    for name in ("etype_pairs", "sim_ngram", "layers_of_dag", "layers_in_order"):
        made = plan(own.QUERIES[name](spark, SF))
        assert not any(x in made for x in ("CartesianProduct", "NestedLoop", "Python", "Pandas")), name
