"""python -m kindred STEP: the steps from ontology files to a classifier's measures, each reading what those before it wrote.

parse     ontology files to exported triples
context   exported triples to contexts; with --schema, a hierarchy's parquet, of entities in place of types
match     contexts and alignments to feature rows, appended to a table
train     one or more feature tables to predictions and measures
run       context, match and train in one
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession

from kindred.operators.learn import measures
from kindred.plans.engine import EtypeEngine
from kindred.sources import ontology, tables


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kindred", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    steps = p.add_subparsers(dest="step", required=True)

    def step(name: str, *needed: str) -> argparse.ArgumentParser:
        s = steps.add_parser(name)
        for n in (*needed, "out"):
            s.add_argument(f"--{n}", required=True)
        return s

    s = step("parse", "ontologies")
    s.add_argument("--ntriples", action="store_true", help="files hold N-Triples, not RDF/XML")
    s.add_argument("--keep-literals", action="store_true")
    s = step("context", "triples")
    s.add_argument("--schema", help="a hierarchy table: instance mode")
    for s in (step("match", "contexts", "alignments"), run := step("run", "triples", "alignments")):
        s.add_argument("--blind", action="store_true", help="match properties by name instead of by the alignments")
    s = step("train")
    s.add_argument("--features", required=True, nargs="+", help="feature tables, which train together")
    for s in (s, run):
        s.add_argument("--model", default="ANN", help="DecisionTree, XGBoost, ANN, RandomForest, LogisticRegression or SGDClassifier")
    return p


def trained(engine: EtypeEngine, features: DataFrame, model: str, out: str) -> None:
    predicted = engine.train(features, model)
    ontology.write_results(predicted, out)
    measures(predicted).show(vertical=True)


def main(given: list[str] | None = None) -> None:
    a = arguments().parse_args(given)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    engine = EtypeEngine(spark)
    if a.step == "parse":
        graph = ontology.read_ntriples(spark, a.ontologies) if a.ntriples else ontology.read_ontologies(spark, a.ontologies)
        ontology.export_triples(ontology.triples(graph, "keep" if a.keep_literals else "cut"), a.out, datetime.date.today())
    elif a.step == "context":
        triples = ontology.read_exported(spark, a.triples)
        schema = spark.read.parquet(a.schema) if a.schema else None
        if schema is None:
            ontology.write_hierarchy(engine.hierarchy(triples), f"{a.out}/hierarchy")
        tables.write_context(engine.build_context(triples, schema), a.out)
    elif a.step == "match":
        c = tables.read_context(spark, a.contexts)
        tables.write_features(engine.match(c, c, ontology.read_alignments(spark, a.alignments), blind=a.blind), a.out)
    elif a.step == "train":
        trained(engine, tables.read_features(spark, *a.features), a.model, a.out)
    else:
        c = engine.build_context(ontology.read_exported(spark, a.triples))
        trained(engine, engine.match(c, c, ontology.read_alignments(spark, a.alignments), blind=a.blind), a.model, a.out)


if __name__ == "__main__":
    main()
