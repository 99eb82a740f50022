"""The corpus pipeline: documents in, sampled piece ids of what stays out. Each stage calls one operator of kindred.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, line_dedup, minhash, pieces, toxicity
from kindred.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the table's own labels, doesn't call toxic. The sample is read from the table of documents.
    Each row is judged by its own text, whatever its id; a null or empty text has no words, so the model's bias alone decides for it. No rows give none."""
    settings = toxicity.Settings()
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), settings)
    return toxicity.score(docs, model, settings).where(F.col("kd_score") < settings.threshold).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with later occurrences of repeated three-line windows taken out of their texts and n_chars counted again.
    A null text stays null; rows of one id and text count once and get the same result; a null id comes first in the order that says which occurrence is later."""
    out = line_dedup.dedup_lines(docs)
    return out.select(*(F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (0.8 alike or more on shingles of five words), and all others.
    Texts without words, and null ones, are alike to nothing; rows of one id are one document, and rows of a null id all stay."""
    return minhash.drop_near_copies(docs, minhash.FIVE_WORDS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item. All rows of an id go together; those of a null id go by their own text. Null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, n_chars and lossless (the ids decode to the text) of each document, repeated rows and those of a null id too; a null or empty text has no ids."""
    encoded = pieces.encode(docs.select("doc_id", "text"))
    return pieces.digests(encoded, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode_pieces),
]

#: A trained classifier and sampled segmentations are not SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
