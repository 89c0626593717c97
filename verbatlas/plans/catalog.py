"""The registered queries of the core library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verbatlas.plans import archives, corpus, inputs_and_outputs, tagging, text_actions, training_data, trees_and_records

MODULES = (text_actions, tagging, trees_and_records, corpus, archives, training_data, inputs_and_outputs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
