"""Ontologies and alignments: readers of RDF/XML, N-Triples and alignment files, and what files of results need."""

from __future__ import annotations

import datetime
import re
import sys
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.terms import fragment, local_name, union_label, with_labels
from kindred.operators.hierarchy import ancestor_distances
from kindred.plans.scratch import discard, written
from kindred.sources.files import write_xlsx
from kindred.sources.tables import read_xlsx

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # readers go to executors whole: they need no installation of this package

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XML_BASE = "{http://www.w3.org/XML/1998/namespace}base"
GRAPH = "kg string, subject string, predicate string, object string, object_kind string"
# Columns of the exported table, and rows of one exported file, as spreadsheets hold no more with a header.
EXPORT = ["Date", "Subject", "Predicate", "Object", "SubjectTerm", "PredicateTerm", "ObjectTerm", "Domain", "Domain Version", "Domain Date", "URI", "Title", "Languages"]
TEXT_ROWS = 1_048_574


def rdf_xml_triples(text: str, base: str = "") -> Iterator[tuple[str, str, str, str]]:
    """(subject, predicate, object, kind) of an RDF/XML document: typed nodes, property elements and attributes, collections, blank nodes."""
    root = ET.fromstring(text)
    base = root.get(XML_BASE, base)
    count = 0

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:b{count}"

    def iri(name: str) -> str:
        return name[1:].replace("}", "") if name.startswith("{") else name

    def resolved(ref: str) -> str:
        return ref if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref) else (base.rstrip("#") + ref if ref.startswith("#") or not ref else base.rstrip("#/") + "/" + ref)

    def node(e: ET.Element) -> tuple[str, str, list]:
        about, own_id, node_id = e.get(f"{RDF}about"), e.get(f"{RDF}ID"), e.get(f"{RDF}nodeID")
        subject = resolved(about) if about is not None else resolved(f"#{own_id}") if own_id else f"_:{node_id}" if node_id else blank()
        kind = "bnode" if subject.startswith("_:") else "iri"
        out = []
        if e.tag != f"{RDF}Description":
            out.append((subject, f"{RDF[1:-1]}type", iri(e.tag), "iri"))
        for k, v in e.attrib.items():
            if not k.startswith((RDF, "{http://www.w3.org/XML/")):
                out.append((subject, iri(k), v, "literal"))
            elif k == f"{RDF}type":
                out.append((subject, iri(k), resolved(v), "iri"))
        for child in e:
            out += prop(subject, child)
        return subject, kind, out

    def prop(subject: str, e: ET.Element) -> list:
        name = iri(e.tag)
        if (ref := e.get(f"{RDF}resource")) is not None:
            return [(subject, name, resolved(ref), "iri")]
        if ref := e.get(f"{RDF}nodeID"):
            return [(subject, name, f"_:{ref}", "bnode")]
        how = e.get(f"{RDF}parseType")
        if how == "Collection":
            out, cells = [], [blank() for _ in e] or []
            out.append((subject, name, cells[0], "bnode") if cells else (subject, name, f"{RDF[1:-1]}nil", "iri"))
            for k, child in enumerate(e):
                s, kind, inner = node(child)
                out += [*inner, (cells[k], f"{RDF[1:-1]}first", s, kind)]
                rest = cells[k + 1] if k + 1 < len(cells) else None
                out.append((cells[k], f"{RDF[1:-1]}rest", rest or f"{RDF[1:-1]}nil", "bnode" if rest else "iri"))
            return out
        if how == "Resource":
            s = blank()
            return [(subject, name, s, "bnode"), *(x for child in e for x in prop(s, child))]
        if len(e):
            out = []
            for child in e:
                s, kind, inner = node(child)
                out += [(subject, name, s, kind), *inner]
            return out
        return [(subject, name, e.text or "", "literal")]

    for e in root if root.tag == f"{RDF}RDF" else [root]:
        yield from node(e)[2]


def read_ontologies(spark: SparkSession, path: str) -> DataFrame:
    """Triples (kg, subject, predicate, object, object_kind) of all .rdf and .owl files of a folder, read whole by Spark on any store, one file a row.

    kg is the file's name up to its first dot. A file that can't be parsed has no triples; its error is in the task's log.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"(?i)\.(rdf|owl)[^/]*$")).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                kg = file.rsplit("/", 1)[-1].split(".")[0]
                try:
                    rows = [(kg, *x) for x in rdf_xml_triples(content.as_py().decode("utf-8-sig"), file)]
                except (ET.ParseError, UnicodeDecodeError) as e:
                    print(f"{file}: {e}")
                    continue
                for k in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[k : k + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kg", "subject", "predicate", "object", "object_kind"])

    return files.mapInArrow(run, GRAPH)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files, line by line in Spark; lines that are no triples are skipped."""
    line = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"\S*)\s*\.\s*(?:#.*)?$"
    lines = spark.read.text(path).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).where(F.col("value").rlike(line))
    part = lambda k: F.regexp_extract("value", line, k)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[<\"]", ""), r"(?:>|\"(?:@[A-Za-z0-9-]+|\^\^\S+)?)$", "")
    kind = F.when(F.startswith(part(3), F.lit("<")), "iri").when(F.startswith(part(3), F.lit("_:")), "bnode").otherwise("literal")
    return lines.select(F.split_part("file", F.lit("."), F.lit(1)).alias("kg"), bare(part(1)).alias("subject"), part(2).alias("predicate"), bare(part(3)).alias("object"), kind.alias("object_kind"))


def list_places(graph: DataFrame) -> DataFrame:
    """(kg, cell, end, after, member): each cell of the lists of a graph, its list's last cell, how many cells come after it, and its member.

    Cells point to the next one, and pointers double each round, so rounds grow with the logarithm of the longest list and rows stay those of the cells. Lists share no cells; a
    cell's least `first` and `rest` count, and cells that lead into a circle belong to no list.
    Joins here and in `expressions` are merges by hint: sizes are estimated from packed files, and these tables would go to the driver and to every executor as broadcasts many times as large.
    """
    short = graph.withColumn("p", local_name(F.col("predicate"))).where("p in ('first', 'rest')")
    cells = short.groupBy("kg", F.col("subject").alias("cell")).agg(F.min(F.when(F.col("p") == "first", F.col("object"))).alias("member"), F.min(F.when(F.col("p") == "rest", F.col("object"))).alias("next"))
    cells = written(cells.where("member is not null"), "cells")
    known = cells.select("kg", F.col("cell").alias("next"), F.lit(1).alias("step"))
    step = F.coalesce("step", F.lit(0)).cast("long")
    now = written(cells.join(known.hint("merge"), ["kg", "next"], "left").select("kg", "cell", F.when(step == 1, F.col("next")).otherwise(F.col("cell")).alias("end"), step.alias("after")), "places")
    size, most = now.agg(F.count("*"), F.sum("after")).first(), now.count()
    while True:
        doubled = now.alias("a").join(now.alias("b").hint("merge"), (F.col("a.kg") == F.col("b.kg")) & (F.col("a.end") == F.col("b.cell"))).select("a.kg", "a.cell", "b.end", (F.col("a.after") + F.col("b.after")).alias("after"))
        old, now = now, written(doubled.where(F.col("after") <= most), "places")  # in a circle, steps soon outnumber the cells
        discard(old)
        if (grown := now.agg(F.count("*"), F.sum("after")).first()) == size:
            return now.join(cells.select("kg", "cell", "member").hint("merge"), ["kg", "cell"])
        size = grown


def expressions(graph: DataFrame) -> DataFrame:
    """(kg, bnode, members): the classes that a blank node's expression names, in its order, as 'A|B'.

    Members of unions and intersections and the classes of restrictions (someValuesFrom, allValuesFrom, onClass) count, to any depth; what a complement names doesn't. Nested blank nodes are replaced by what they stand for,
    with paths that double each round. Blank nodes that lead to themselves, and those that name no class, have no row.
    """
    short = graph.select("kg", "subject", local_name(F.col("predicate")).alias("p"), "object", "object_kind")
    heads = short.where("p in ('unionOf', 'intersectionOf')").select("kg", F.col("subject").alias("root"), F.col("object").alias("cell"))
    places = list_places(graph)
    first = heads.join(places.select("kg", "cell", "end", F.col("after").alias("whole")).hint("merge"), ["kg", "cell"]).drop("cell")
    listed = first.join(places.hint("merge"), ["kg", "end"]).where("after <= whole").select("kg", "root", F.array(F.col("whole") - F.col("after")).alias("path"), F.col("member").alias("leaf"))
    filled = short.where("p in ('someValuesFrom', 'allValuesFrom', 'onClass')").select("kg", F.col("subject").alias("root"), F.array(F.lit(0).cast("long")).alias("path"), F.col("object").alias("leaf"))
    now = written(listed.unionByName(filled), "expressions")
    blank = F.startswith("leaf", F.lit("_:"))
    inner = now.where(blank).select("kg", F.col("root").alias("child"), F.col("leaf").alias("parent"))
    if not inner.isEmpty():  # a blank node with itself below it would unfold for ever
        circles = ancestor_distances(inner).where("node = ancestor").select("kg", F.col("node").alias("root")).unionByName(now.where("root = leaf").select("kg", "root")).distinct()
        now = written(now.join(circles.hint("merge"), ["kg", "root"], "left_anti"), "expressions")
    while not now.where(blank).isEmpty():
        closed = now.where(~blank)
        further = now.where(blank).alias("a").join(now.alias("b").hint("merge"), (F.col("a.kg") == F.col("b.kg")) & (F.col("a.leaf") == F.col("b.root"))).select("a.kg", "a.root", F.concat("a.path", "b.path").alias("path"), "b.leaf")
        old, now = now, written(closed.unionByName(further), "expressions")
        discard(old)
    ordered = F.array_sort(F.collect_list(F.struct("path", local_name(F.col("leaf")).alias("m"))))
    return now.groupBy("kg", F.col("root").alias("bnode")).agg(union_label(F.array_join(F.transform(ordered, lambda x: x["m"]), "|")).alias("members"))


def subclasses(graph: DataFrame) -> DataFrame:
    """(kg, subject, below): the names of all classes below each subject that has a blank superclass, in order, as 'A|B'; '' without any."""
    parts = graph.where(F.contains(F.lower(local_name(F.col("predicate"))), F.lit("subclass")))
    asked = parts.where("object_kind = 'bnode'").select("kg", "subject").distinct()
    named = parts.where("object_kind = 'iri' and subject not like '\\_:%'").select("kg", F.col("subject").alias("child"), F.col("object").alias("parent"))
    below = ancestor_distances(named).where("node != ancestor").select("kg", F.col("ancestor").alias("subject"), local_name(F.col("node")).alias("name"))
    return asked.join(below, ["kg", "subject"], "left").groupBy("kg", "subject").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("below"))


def labels(graph: DataFrame) -> DataFrame:
    """(iri, label): the least label of each IRI."""
    return graph.where(local_name(F.col("predicate")) == "label").groupBy(F.col("subject").alias("iri")).agg(F.min("object").alias("label"))


def triples(graph: DataFrame, literals: str = "cut", coded: bool = True, blank_parents: str = "drop") -> DataFrame:
    """(kg, subject, predicate, object, subject_term, predicate_term, object_term): terms are local names; blank objects of domain and range are their `expressions`'
    classes, other blank objects "BNode"; terms of coded vocabularies are replaced by labels. Literals are cut like IRIs, or kept with literals="keep".
    blank_parents="subclasses" puts the names of the subject's own `subclasses` in place of a blank superclass, as an older script did: a single one then reads as a parent."""
    if literals not in ("cut", "keep"):
        raise ValueError("literals is 'cut' or 'keep'")
    if blank_parents not in ("drop", "subclasses"):
        raise ValueError("blank_parents is 'drop' or 'subclasses'")
    joined = graph.join(expressions(graph).withColumnRenamed("bnode", "object").hint("merge"), ["kg", "object"], "left")
    predicate = local_name(F.col("predicate"))
    blank = F.when(predicate.isin("domain", "range"), F.coalesce("members", F.lit("BNode")))
    if blank_parents == "subclasses":
        joined = joined.join(subclasses(graph).hint("merge"), ["kg", "subject"], "left")
        blank = blank.when(F.contains(F.lower(predicate), F.lit("subclass")), F.col("below"))
    blank = blank.otherwise(F.lit("BNode"))
    text = local_name(F.col("object")) if literals == "cut" else F.when(F.col("object_kind") == "literal", F.col("object")).otherwise(local_name(F.col("object")))
    term = F.when(F.col("object_kind") == "bnode", blank).otherwise(text)
    out = joined.select("kg", "subject", "predicate", "object", local_name(F.col("subject")).alias("subject_term"), predicate.alias("predicate_term"), term.alias("object_term"))
    return with_labels(out, labels(graph)) if coded else out


def _exported(table: DataFrame, date: datetime.date) -> DataFrame:
    day = F.lit(date.isoformat())
    values = [day, "subject", "predicate", "object", "subject_term", "predicate_term", "object_term", "kg", F.lit("v1.0"), day, F.lit("URI"), F.lit("Title"), F.lit("en")]
    return table.select(*((F.col(v) if isinstance(v, str) else v).alias(name) for v, name in zip(values, EXPORT, strict=True)))


def _imported(rows: DataFrame) -> DataFrame:
    names = {"kg": "Domain", "subject": "Subject", "predicate": "Predicate", "object": "Object", "subject_term": "SubjectTerm", "predicate_term": "PredicateTerm", "object_term": "ObjectTerm"}
    return rows.select(*(F.col(c).alias(name) for name, c in names.items()))


def export_triples(table: DataFrame, path: str, date: datetime.date) -> None:
    """Writes the 13-column table as CSV, files of at most TEXT_ROWS rows."""
    _exported(table, date).write.option("header", True).option("maxRecordsPerFile", TEXT_ROWS).csv(path)


def export_sheets(table: DataFrame, path: str, date: datetime.date, terms_only: bool = False, rows: int = TEXT_ROWS) -> None:
    """Appends the 13-column table, or its columns of terms alone, as spreadsheets of at most `rows` rows."""
    made = _exported(table, date)
    write_xlsx(made.select("SubjectTerm", "PredicateTerm", "ObjectTerm") if terms_only else made, path, rows=rows)


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """Triples from exported CSV files; files whose names hold ~ or ._ are skipped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in EXPORT])
    rows = spark.read.schema(schema).option("header", True).csv(path).where(~F.element_at(F.split(F.input_file_name(), "/"), -1).rlike(r"~|\._"))
    return _imported(rows)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Triples from a folder of exported spreadsheets; columns that a sheet hasn't got are null."""
    return _imported(read_xlsx(spark, path, EXPORT))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(kg1, kg2, e1, e2) of alignment files named <kg1>-<kg2>.<ending>: the part after # of each cell's entities, null without one. Names that begin with ._ are skipped."""
    rows = spark.read.format("xml").option("rowTag", "Cell").schema("entity1 struct<`_rdf:resource`:string>, entity2 struct<`_rdf:resource`:string>").load(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    kg = lambda k: F.regexp_extract(F.split_part(name, F.lit("."), F.lit(1)), "^([^-]+)-([^-]+)", k)
    return rows.where(~F.startswith(name, F.lit("._"))).select(kg(1).alias("kg1"), kg(2).alias("kg2"), fragment(F.col("entity1")["_rdf:resource"]).alias("e1"), fragment(F.col("entity2")["_rdf:resource"]).alias("e2"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, embedding) of word2vec's text format; the line of counts is skipped."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).where(F.size(parts) > 2)
    return rows.select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("embedding"))


def write_hierarchy(table: DataFrame, path: str) -> None:
    """CSV with arrays as JSON and -1 where there is none; parquet keeps arrays and is what later steps read."""
    arrays = ["super_classes", "sub_classes", "path", "all_sub_classes"]
    table.write.partitionBy("kg").parquet(f"{path}/parquet")
    table.select(*(F.coalesce(F.to_json(c), F.lit("-1")).alias(c) if c in arrays else F.col(c) for c in table.columns)).write.option("header", True).csv(f"{path}/csv")


def write_matrix(cells: DataFrame, path: str) -> None:
    cells.write.partitionBy("kg").parquet(path)


def write_results(predicted: DataFrame, path: str) -> None:
    """true, pred and correct rows as CSV."""
    for name, condition in (("true", "match = 1"), ("pred", "predict = 1"), ("correct", "match = 1 and predict = 1")):
        predicted.where(condition).write.option("header", True).csv(f"{path}/{name}")
