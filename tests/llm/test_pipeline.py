"""The pipeline's stages over the small tables, each held against a plain version of itself."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm.common import table, written

from .conftest import prose
from .test_dedup import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    bench = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = written(stage(spark, docs, SF), "test")
        rows = out.collect()
        if name == "line dedup":
            assert {r.doc_id: r.text for r in rows} == brute_lines(before) and all(r.n_chars == len(r.text) for r in rows)
        elif name == "near-dedup":
            assert {r.doc_id for r in rows} == {i for i, c in brute_components(before, 5, 80).items() if i == c}
        elif name == "decontamination":
            assert not [r.doc_id for r in rows if any(t in r.text for t in bench.values())] and len(rows) > 0.9 * len(before)
        elif name == "sentencepiece":
            assert {r.doc_id for r in rows} == set(before) and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
        else:
            assert 0.8 * len(before) < len(rows) <= len(before)
        if name != "sentencepiece":
            assert out.columns == columns
        docs = out


def test_run_gives_what_the_stages_give(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100 and corpus_pipeline.ORACLE_SQL is None


def five_word_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_dedup_takes_five_words_at_four_fifths(spark):
    """An added passage (0.82 on five words, below 0.85 on three) makes a copy; scattered edits (0.85 or more on three, below 0.8 on five) don't; nor does 0.79."""
    base = prose(70, 500).split()
    longer, too_long = [*base, *prose(71, 109).split()], [*base, *prose(72, 131).split()]
    other = prose(73, 500).split()
    edited = [f"edit{i}" if i % 38 == 19 else w for i, w in enumerate(other)]
    third = prose(74, 500).split()
    docs = {1: base, 2: longer, 3: other, 4: edited, 5: third, 6: [*third, *prose(75, 131).split()], 7: too_long[500:]}
    docs = {i: " ".join(w) for i, w in docs.items()}
    assert 0.8 <= five_word_similarity(docs[1], docs[2]) < 0.85 and 0.75 < five_word_similarity(docs[3], docs[4]) < 0.8 and 0.78 < five_word_similarity(docs[5], docs[6]) < 0.8
    assert brute_components(docs) == {i: 3 if i == 4 else i for i in docs}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()} == {1, 3, 4, 5, 6, 7}


def test_near_dedup_of_a_table_equals_five_word_brute_force(spark):
    docs = table(spark, SF, "documents")
    root = brute_components({r.doc_id: r.text for r in docs.collect()}, 5, 80)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == {i for i, r in root.items() if i == r}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_a_stage_of_odd_tables(spark, odd_docs, clashing, name, stage):
    """Null ids and texts, empty, blank and very long texts, repeated rows, clashing names; then no rows at all."""
    bench = table(spark, SF, "benchmark").first().text
    odd = odd_docs.unionByName(odd_docs.where("doc_id = 2").withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(bench)}))
    out = stage(spark, odd, SF)
    ids = sorted(str(r.doc_id) for r in out.collect())
    every = sorted(str(r.doc_id) for r in odd.collect())
    assert name == "sentencepiece" or out.columns == odd.columns
    if name in ("line dedup", "sentencepiece"):
        assert ids == every
    elif name == "decontamination":
        assert ids == sorted(str(r.doc_id) for r in odd_docs.collect())
    elif name == "near-dedup":
        assert set(ids) == set(every) and ids.count("6") >= 1
    else:
        assert set(ids) <= set(every)
    again = stage(spark, clashing, SF)
    assert name == "sentencepiece" or again.columns == clashing.columns
    assert 0 < again.count() <= 6 and stage(spark, odd.limit(0), SF).count() == 0
