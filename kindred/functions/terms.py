"""Names and labels of ontology terms as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes of coded vocabularies, in the order in which they are looked for.
CODED = ("ERO", "OBI", "BFO", "IAO", "RO", "SWO", "ERO", "ARG", "FLOPO", "PATO", "PO", "ENVO")
# Predicates that tie a property to an entity type.
PROPERTY_PREDICATES = ("domain", "domainIncludes", "range")
# Common English stop words.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: A word of a camel-case name: up to a lower-upper step, or to the last capital of a run before a capitalised word.
CAMEL = r".+?(?:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|$)"


def local_name(iri: Column) -> Column:
    """The part after the last / or #; if that is empty, the part before it."""
    parts = F.split(F.regexp_replace(iri, "/", "#"), "#", -1)
    last = F.element_at(parts, -1)
    return F.when((last == "") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(last)


def fragment(iri: Column) -> Column:
    """The part between the first and the second #; null without a #."""
    return F.try_element_at(F.split(iri, "#", -1), F.lit(2))


def union_label(items: Column) -> Column:
    """'a.X|b.Y' to 'X|Y': each piece's last dotted segment."""
    return F.array_join(F.transform(F.split(items, r"\|", -1), lambda x: F.element_at(F.split(F.trim(x), r"\.", -1), -1)), "|")


def union_pieces(term: Column) -> Column:
    return F.split(term, r"\|", -1)


def formal_label(label: Column) -> Column:
    """Letters and digits only, in lower case: the key by which properties of two ontologies meet."""
    return F.lower(F.regexp_replace(label, "[^A-Za-z0-9]", ""))


def quick_label(label: Column) -> Column:
    return F.lower(F.trim(F.translate(label, "_-", "")))


def camel_words(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(CAMEL), F.lit(0))


def name_words(name: Column) -> Column:
    """Words of a name in lower case: split at _ if there is one, else at -, else at camel-case steps."""
    parts = F.when(F.contains(name, F.lit("_")), F.split(name, "_", -1)).when(F.contains(name, F.lit("-")), F.split(name, "-", -1)).otherwise(camel_words(name))
    return F.transform(parts, F.lower)


def capital_pieces(word: Column) -> Column:
    """Pieces that each begin with any character and go up to the next capital, without hyphens."""
    return F.transform(F.regexp_extract_all(word, F.lit(".[^A-Z]*"), F.lit(0)), lambda x: F.regexp_replace(x, "-", ""))


def spaced_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def without_stop_words(words: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words that are neither stop words nor digits; all of them if none is left."""
    left = F.filter(words, lambda x: ~F.lower(x).isin(*stop_words) & ~x.rlike("^[0-9]+$"))
    # what is left is bound once, as the element of a list, so that it isn't filtered again for its size
    return F.get(F.transform(F.array(left), lambda own: F.when(F.size(own) == 0, words).otherwise(own)), F.lit(0))


def matrix_tokens(text: Column) -> Column:
    """Tokens that name matrix columns; case stays."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_-]+"), F.lit(0))


def with_labels(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """Replaces terms of coded vocabularies by labels.

    triples: subject, predicate, object and their *_term columns; labels: iri, label (one a term). A term that holds a coded prefix becomes the label of its
    IRI, or the IRI itself without one; an object term with | is replaced piece by piece, by all labels or not at all. As replacements can
    hold a prefix again, a replacement that does is looked up no more: its own label would be the same.
    """
    one = labels.groupBy("iri").agg(F.min("label").alias("label"))
    coded = lambda c: reduce(lambda x, y: x | y, (F.contains(c, F.lit(p)) for p in dict.fromkeys(CODED)))
    out = triples
    for part in ("subject", "predicate", "object"):
        term = F.col(f"{part}_term")
        named = one.select(F.col("iri").alias(f"{part}_iri"), F.col("label").alias(f"{part}_label"))
        out = out.join(named, F.col(part) == F.col(f"{part}_iri"), "left")
        whole = coded(term) & ~F.contains(term, F.lit("|")) if part == "object" else coded(term)
        out = out.withColumn(f"{part}_term", F.when(whole, F.coalesce(f"{part}_label", part)).otherwise(term)).drop(f"{part}_iri", f"{part}_label")
    unions = out.where(F.contains("object_term", F.lit("|")) & coded(F.col("object_term"))).select("object_term").distinct()
    by_name = one.groupBy(local_name(F.col("iri")).alias("piece")).agg(F.min("label").alias("label"))
    pieces = unions.select("object_term", F.posexplode(union_pieces(F.col("object_term"))).alias("pos", "piece")).join(by_name, "piece", "left")
    joined = pieces.groupBy("object_term").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), "|").alias("labelled"), F.count_if(F.col("label").isNull()).alias("missing")
    )
    out = out.join(joined.where("missing = 0").select("object_term", "labelled"), "object_term", "left")
    return out.withColumn("object_term", F.coalesce("labelled", "object_term")).select(*triples.columns)
