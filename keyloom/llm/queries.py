"""Queries of problems 7 to 9 over a data folder. SQL can express none of them; their tests hold them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import leakage, packing, subjects
from keyloom.sources.shared import checkpointed
from keyloom.sources.tables import read_table as t


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(t(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(checkpointed(packing.packed(t(spark, d, "documents")), "p7"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(t(spark, d, "documents"), t(spark, d, "eval_passage"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(t(spark, d, "documents"), t(spark, d, "eval_passage"))


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t(spark, d, "documents"), t(spark, d, "subject_label"), t(spark, d, "subject_list")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(*_p9(spark, d)).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(*_p9(spark, d))


def p9_functions(spark: SparkSession, d: str) -> DataFrame:
    return subjects.function_report(*_p9(spark, d))


def p9_associations(spark: SparkSession, d: str) -> DataFrame:
    return subjects.association_report(*_p9(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p7_packed, p7_fill, p8_found, p8_items, p9_found, p9_composition, p9_functions, p9_associations)}


def oracle_sql() -> dict[str, str]:
    return {}
