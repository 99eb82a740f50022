"""The text operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Each query's module and tables. A module is imported when its query runs, so one needs the libraries of its own operator only.
OPERATORS = {
    "op1_minhash": ("minhash", "documents"),
    "op2_token_ids": ("tokens", "documents"),
    "op3_html": ("html", "pages"),
    "op4_quality": ("quality", "documents", "labels"),
    "op5_licenses": ("licenses", "documents"),
    "op6_toxicity": ("toxicity", "documents", "labels"),
    "op7_line_dedup": ("line_dedup", "documents"),
    "op8_token_counts": ("pieces", "documents"),
    "op9_sentencepiece": ("pieces", "documents"),
    "op10_decontaminate": ("decontaminate", "documents", "benchmark"),
    "op11_sharding": ("sharding", "documents"),
    "op12_collocations": ("collocations", "documents"),
    "op13_periodic": ("periodic", "documents"),
}
WITH_SQL = ("op1_minhash", "op7_line_dedup", "op11_sharding", "op12_collocations")


def _module(name: str):
    return importlib.import_module(f"kindred.llm.{OPERATORS[name][0]}")


def _query(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(_module(name), name)(*(table(spark, sf_dir, t) for t in OPERATORS[name][1:]))

    query.__name__ = name
    return query


def queries() -> dict[str, Query]:
    return {name: _query(name) for name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(_module(name), name.split("_")[0].upper() + "_SQL") for name in WITH_SQL}
