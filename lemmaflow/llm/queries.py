"""Queries on training text by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lemmaflow.llm import cut, leak, mix
from lemmaflow.llm.sql import ORACLE  # noqa: F401
from lemmaflow.sources.tables import table


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.found(_spans(spark, d))


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(*mix.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return cut.found(cut.truncated_documents(table(spark, d, "documents")))


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return cut.truncation_report(docs, cut.truncated_documents(docs))


QUERIES = {f.__name__: f for f in (p6_found, p6_spans, p7_shares, p7_selection, p8_found, p8_sources)}
