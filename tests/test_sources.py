import datetime
import struct
import xml.etree.ElementTree as ET
import zipfile
from pathlib import Path

import pytest

from kindred.__main__ import main
from kindred.functions import similarity, terms
from kindred.operators import context
from kindred.plans.engine import EtypeEngine
from kindred.sources import files, ontology, tables
from pyspark.sql import functions as F

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://x.org/o">
<owl:Class rdf:about="#Person"><rdfs:label>A person/human</rdfs:label></owl:Class>
<owl:Class rdf:ID="Paper"/>
<owl:Class rdf:about="http://x.org/OBI_1"><rdfs:label>assay</rdfs:label><rdfs:subClassOf rdf:resource="#Paper"/></owl:Class>
<owl:ObjectProperty rdf:about="#has"><rdfs:domain><owl:Class><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="#Person"/><owl:Class rdf:about="#Paper"/></owl:unionOf></owl:Class></rdfs:domain></owl:ObjectProperty>
</rdf:RDF>"""


def test_rdf_xml(spark, tmp_path):
    (tmp_path / "one.owl").write_text(OWL)
    (tmp_path / "broken.rdf").write_text("<rdf")
    (tmp_path / "notes.txt").write_text("x")
    got = {(r.subject_term, r.predicate_term, r.object_term) for r in ontology.triples(ontology.read_ontologies(spark, str(tmp_path))).collect()}
    assert ("has", "domain", "Person|Paper") in got and ("Person", "label", "human") in got and ("assay", "subClassOf", "Paper") in got and ("Paper", "type", "Class") in got


def test_ntriples_alignments_vectors_and_export(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/g.nt").write_text('<http://x#a> <http://x#p> "t \\" x"@en .\n# c\n_:b <http://x#p> <http://x/c/> .\n')
    rows = {tuple(r) for r in ontology.read_ntriples(spark, str(tmp_path / "n")).collect()}
    assert rows == {("g", "http://x#a", "http://x#p", 't \\" x', "literal"), ("g", "_:b", "http://x#p", "http://x/c/", "iri")}
    (tmp_path / "a").mkdir()
    (tmp_path / "a/k1-k2.rdf").write_text('<Alignment xmlns:rdf="r"><map><Cell><entity1 rdf:resource="http://k1#A"/><entity2 rdf:resource="http://k2#B"/><relation>=</relation></Cell></map><map><Cell><entity1 rdf:resource="http://k1/none"/><entity2 rdf:resource="http://k2#C"/></Cell></map></Alignment>')
    assert {tuple(r) for r in ontology.read_alignments(spark, str(tmp_path / "a")).collect()} == {("k1", "k2", "A", "B"), ("k1", "k2", None, "C")}
    (tmp_path / "v.txt").write_text("2 3\nred 1 2 3\nblue 0 0 1\n")
    assert {r.word: r.embedding for r in ontology.read_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"red": [1, 2, 3], "blue": [0, 0, 1]}
    t = ontology.triples(ontology.read_ntriples(spark, str(tmp_path / "n")))
    ontology.export_triples(t, str(tmp_path / "out"), datetime.date(2024, 1, 2))
    assert {r.object_term for r in ontology.read_exported(spark, str(tmp_path / "out")).collect()} == {r.object_term for r in t.collect()}


EXPRESSIONS = """
<owl:Class rdf:about="#Sub"><rdfs:subClassOf rdf:resource="#Top"/><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#p"/><owl:someValuesFrom rdf:resource="#Q"/></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="#Leaf"><rdfs:subClassOf rdf:resource="#Sub"/></owl:Class><owl:Class rdf:about="#Twig"><rdfs:subClassOf rdf:resource="#Leaf"/></owl:Class>
<owl:ObjectProperty rdf:about="#deep"><rdfs:domain><owl:Class><owl:intersectionOf rdf:parseType="Collection"><owl:Class rdf:about="#A"/><owl:Class><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="#B"/>
<owl:Restriction><owl:onProperty rdf:resource="#p"/><owl:allValuesFrom><owl:Class><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="#D"/><owl:Class rdf:about="#C"/></owl:unionOf></owl:Class></owl:allValuesFrom></owl:Restriction></owl:unionOf></owl:Class>
<owl:Class rdf:about="#E"/></owl:intersectionOf></owl:Class></rdfs:domain><rdfs:range><owl:Restriction><owl:onProperty rdf:resource="#p"/><owl:onClass rdf:resource="#F"/></owl:Restriction></rdfs:range></owl:ObjectProperty>
<owl:ObjectProperty rdf:about="#not"><rdfs:domain><owl:Class><owl:complementOf rdf:resource="#A"/></owl:Class></rdfs:domain><rdfs:range><owl:Class><owl:unionOf rdf:resource="http://www.w3.org/1999/02/22-rdf-syntax-ns#nil"/></owl:Class></rdfs:range></owl:ObjectProperty>
<owl:ObjectProperty rdf:about="#round"><rdfs:domain><owl:Class rdf:nodeID="loop"><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="#A"/><owl:Class><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:nodeID="loop"/></owl:unionOf></owl:Class></owl:unionOf></owl:Class></rdfs:domain>
<rdfs:range><owl:Class><owl:unionOf><rdf:List rdf:nodeID="r1"><rdf:first rdf:resource="#A"/><rdf:rest><rdf:List rdf:nodeID="r2"><rdf:first rdf:resource="#B"/><rdf:rest rdf:nodeID="r1"/></rdf:List></rdf:rest></rdf:List></owl:unionOf></owl:Class></rdfs:range></owl:ObjectProperty>
</rdf:RDF>"""


def test_class_expressions(spark, tmp_path):
    """Nested blank nodes, none that name nothing, circles of nodes and of cells; blank superclasses; a graph without any."""
    (tmp_path / "k.owl").write_text(OWL[: OWL.index("<owl:Class")] + EXPRESSIONS)
    graph = ontology.read_ontologies(spark, str(tmp_path)).cache()
    wanted = lambda t: {(r.subject_term, r.predicate_term, r.object_term) for r in t.where("object_kind = 'bnode' and predicate_term in ('domain', 'range', 'subClassOf')").collect()}
    kinds = graph.select("kg", "subject", "predicate", "object", "object_kind")
    read = lambda **options: wanted(ontology.triples(graph, coded=False, **options).join(kinds, ["kg", "subject", "predicate", "object"]))
    same = {("deep", "domain", "A|B|D|C|E"), ("deep", "range", "F"), ("not", "domain", "BNode"), ("not", "range", "BNode"), ("round", "domain", "BNode"), ("round", "range", "BNode")}
    assert read() == same | {("Sub", "subClassOf", "BNode")} and read(blank_parents="subclasses") == same | {("Sub", "subClassOf", "Leaf|Twig")}
    assert ontology.expressions(graph.limit(0)).count() == 0 and ontology.triples(graph.limit(0)).count() == 0
    graph.unpersist()


def test_lists_are_ranked(spark):
    n = 300
    chain = [("k", f"_:c{i}", "first", f"x#m{i}", "iri") for i in range(n)] + [("k", f"_:c{i}", "rest", f"_:c{i + 1}" if i + 1 < n else "x#nil", "bnode") for i in range(n)]
    got = ontology.list_places(spark.createDataFrame([*chain, *(("j", *c[1:]) for c in chain[:1])], ontology.GRAPH)).collect()
    assert {(r.kg, r.cell, r.end, r.after, r.member) for r in got} == {("k", f"_:c{i}", f"_:c{n - 1}", n - 1 - i, f"x#m{i}") for i in range(n)} | {("j", "_:c0", "_:c0", 0, "x#m0")}


def test_binary_vectors(spark, tmp_path):
    """Files of others' making, with and without line ends; spans and files of few records; what is no record or no such file."""
    records = [(f"w{i}é", [i / 4, -1.5, float(i * i)]) for i in range(50)]
    for name, end in (("a.bin", b""), ("b.bin", b"\n")):
        (tmp_path / name).write_bytes(b"50 3\n" + b"".join(w.encode() + b" " + struct.pack("<3f", *v) + end for w, v in records) + b"rest")
    want = [(w, v, k) for k, (w, v) in enumerate(records)]
    for name in ("a.bin", "b.bin"):
        for path in (str(tmp_path / name), f"file://{tmp_path}/{name}"):
            assert sorted(map(tuple, files.read_vectors_binary(spark, path, records=7).collect()), key=lambda r: r[2]) == want
    assert files.read_vectors_binary(spark, str(tmp_path), records=1000).count() == 100
    vectors = spark.createDataFrame(records, "word string, embedding array<double>")
    out = str(tmp_path / "out")
    files.write_vectors_binary(vectors.coalesce(1), out, records=20)
    files.write_vectors_binary(vectors.where("word = 'w1é'"), out)
    assert sorted(p.read_bytes().split(b"\n", 1)[0] for p in Path(out).iterdir()) == [b"1 3", b"10 3", b"20 3", b"20 3"]
    assert sorted((r.word, r.embedding) for r in files.read_vectors_binary(spark, out).collect()) == sorted([*records, records[1]])
    files.write_vectors_binary(vectors.limit(0), str(tmp_path / "none"))
    (tmp_path / "none").mkdir(exist_ok=True)
    assert files.read_vectors_binary(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "empty.bin").write_bytes(b"0 3\n")
    assert files.read_vectors_binary(spark, str(tmp_path / "empty.bin")).count() == 0
    for bad in (b"", b"1\n", b"x y\n", b"2 3\na " + bytes(12)):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises(Exception, match="bad.bin"):
            files.read_vectors_binary(spark, str(tmp_path / "bad.bin"), records=1).collect()
    for row in ((None, [1.0]), ("", [1.0]), ("a b", [1.0]), ("a", None), ("a", []), ("a", [None])):
        with pytest.raises(Exception, match="no record"):
            files.write_vectors_binary(spark.createDataFrame([row], "word string, embedding array<double>"), str(tmp_path / "wrong"))
    with pytest.raises(Exception, match="of 1 and 2 places"):
        files.write_vectors_binary(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "word string, embedding array<double>").coalesce(1), str(tmp_path / "wrong"))
    assert not [p for p in (tmp_path / "wrong").rglob("*") if p.is_file()]


def test_spreadsheets_out(spark, tmp_path):
    """Sheets cut at a small limit; text that XML can't hold, gaps and repeats come back; three columns; too long a cell; no rows."""
    out = str(tmp_path / "s")
    rows = [(i, None if i % 3 == 0 else f" <{i}>&\r\n\t\x01_x0041_é😀 ", i / 2) for i in range(25)] + [(1, "", None)] * 2
    df = spark.createDataFrame(rows, "a long, `b c` string, d double").coalesce(1)
    files.write_xlsx(df, out, rows=10, sheet="A & B")
    assert len(list(Path(out).glob("*.xlsx"))) == 3 and len(list(Path(out).iterdir())) == 3
    got = tables.read_xlsx(spark, out, df.columns)
    assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, ((str(a), b, None if d is None else str(d)) for a, b, d in rows)))
    assert sorted(r["count"] for r in got.groupBy("file").count().collect()) == [7, 10, 10]
    with zipfile.ZipFile(min(Path(out).glob("*.xlsx"))) as z:
        assert z.testzip() is None and all(ET.fromstring(z.read(n)) is not None for n in z.namelist())
    files.write_xlsx(df.select("a", "d"), out)
    assert len(list(Path(out).glob("*.xlsx"))) == 4
    with pytest.raises(Exception, match="32767 characters"):
        files.write_xlsx(spark.range(1).select(F.repeat(F.lit("x"), 32768).alias("x")), str(tmp_path / "long"))
    files.write_xlsx(df.limit(0), str(tmp_path / "none"))
    assert not list(tmp_path.glob("none/*.xlsx")) and not list(tmp_path.glob("long/*.xlsx"))
    t = spark.createDataFrame([("k", "s", "p", "o", f"s{i}", "p", None if i == 2 else f"a|{i}") for i in range(5)], "kg string, subject string, predicate string, object string, subject_term string, predicate_term string, object_term string")
    for name, terms_only in (("full", False), ("easy", True)):
        ontology.export_sheets(t.coalesce(1), str(tmp_path / name), datetime.date(2024, 1, 2), terms_only, rows=3)
        back = ontology.read_sheets(spark, str(tmp_path / name))
        kept = ["subject_term", "predicate_term", "object_term"] if terms_only else t.columns
        assert len(list((tmp_path / name).iterdir())) == 2 and sorted(map(str, back.select(kept).collect())) == sorted(map(str, t.select(kept).collect()))
    wide = spark.range(2).select(*((F.col("id") * k).alias(f"c{k}") for k in range(60)))
    files.write_xlsx(wide, str(tmp_path / "wide"))
    assert sorted(int(r.c59) for r in tables.read_xlsx(spark, str(tmp_path / "wide"), ["c59"]).collect()) == [0, 59]


def test_terms_and_similarities(spark):
    df = spark.createDataFrame([("http://x/a#", "hasHTMLName", "abcbdab", "bdcaba"), ("", "", "", "")], "iri string, name string, a string, b string")
    r, empty = df.select(
        terms.local_name(F.col("iri")).alias("local"), terms.name_words(F.col("name")).alias("words"), similarity.lcs_length(F.col("a"), F.col("b")).alias("lcs"), similarity.lcs_length(F.col("a"), F.col("b"), substring=True).alias("sub"),
        similarity.ngram1(F.col("a"), F.col("b")).alias("n"), similarity.levenshtein(F.col("a"), F.col("b")).alias("lev"), terms.fragment(F.col("iri")).alias("frag"),
    ).collect()
    assert (r.local, r.words, r.lcs, r.sub, r.n, r.frag) == ("a", ["has", "html", "name"], 4, 2, 6 / 7, "")
    assert (empty.local, empty.lcs, empty.n, empty.lev, empty.frag) == ("", 0, 0, 1, None)


def test_spreadsheets(spark, tmp_path):
    """Shared, inline and plain cells, gaps, and a file that an editor holds open."""
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>SubjectTerm</t></is></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="s"><v>2</v></c></row><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row>'
    strings = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Domain</t></si><si><t>ObjectTerm</t></si><si><r><t>a</t></r><r><t> b</t></r></si></sst>'
    for name in ("one.xlsx", "~one.xlsx"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", sheet.format(rows))
            z.writestr("xl/sharedStrings.xml", strings)
    got = tables.read_xlsx(spark, str(tmp_path), ["Domain", "SubjectTerm", "ObjectTerm", "none"])
    assert {tuple(r) for r in got.collect()} == {("7", None, "a b", None, "one.xlsx"), (None, "x", None, None, "one.xlsx")}


def test_steps_from_files_to_measures(spark, tmp_path):
    """The command's steps, each from what those before wrote; contexts come back as they were; two feature tables train together."""
    (tmp_path / "o").mkdir()
    (tmp_path / "a").mkdir()
    for kg in ("k1", "k2"):
        classes = "".join(f'<owl:Class rdf:about="#C{i}"/>' for i in range(24))
        props = "".join(f'<owl:ObjectProperty rdf:about="#p{i}"><rdfs:domain rdf:resource="#C{i}"/><rdfs:domain rdf:resource="#C{i * 5 % 24}"/></owl:ObjectProperty>' for i in range(24))
        (tmp_path / f"o/{kg}.owl").write_text(OWL[: OWL.index("<owl:Class")] + classes + props + "</rdf:RDF>")
    cells = "".join(f'<map><Cell><entity1 rdf:resource="http://x.org/o#C{i}"/><entity2 rdf:resource="http://x.org/o#C{i}"/></Cell></map>' for i in range(4))
    (tmp_path / "a/k1-k2.rdf").write_text(f'<Alignment xmlns:rdf="r">{cells}</Alignment>')
    path = lambda name: str(tmp_path / name)
    main(["parse", "--ontologies", path("o"), "--out", path("t")])
    main(["context", "--triples", path("t"), "--out", path("c")])
    for out in ("f", "g"):
        main(["match", "--contexts", path("c"), "--alignments", path("a"), "--blind", "--out", path(out)])
    main(["train", "--features", path("f"), path("g"), "--model", "DecisionTree", "--out", path("r")])
    c = tables.read_context(spark, path("c"))
    want = EtypeEngine(spark).build_context(ontology.read_exported(spark, path("t")))
    for name in tables.PARTS:
        assert sorted(map(str, getattr(c, name).select(getattr(want, name).columns).collect())) == sorted(map(str, getattr(want, name).collect()))
    assert tables.read_features(spark, path("f"), path("g")).count() == 2 * tables.read_features(spark, path("f")).count() > 0
    assert spark.read.option("header", True).csv(path("r/true")).count() > 0
    one = context.dense(c).where("kg = 'k1'")
    tables.write_wide(one, c.meta.where("kg = 'k1'"), "v", path("w"))
    assert {(r.etype, r.property, int(r.v)) for r in tables.read_wide(spark, path("w"), "k1").collect()} == {(r.etype, r.property, r.v) for r in one.collect()}


def test_expressions_are_joined_without_broadcasts(spark):
    """Tables of list cells grow with the graph, however small their packed files are."""
    rows = [("k", "_:u", "x#unionOf", "_:c0", "bnode")]
    for i in range(40):
        rows += [("k", f"_:c{i}", "x#first", f"x#A{i:02d}", "iri"), ("k", f"_:c{i}", "x#rest", f"_:c{i + 1}" if i < 39 else "x#nil", "bnode" if i < 39 else "iri")]
    rows.append(("k", "x#p", "x#domain", "_:u", "bnode"))
    graph = spark.createDataFrame(rows, "kg string, subject string, predicate string, object string, object_kind string")
    made = ontology.triples(graph, coded=False)
    assert [r.object_term for r in made.where("predicate_term = 'domain'").collect()] == ["|".join(f"A{i:02d}" for i in range(40))]
    for df in (made, ontology.list_places(graph)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().toString()
