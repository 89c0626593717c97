"""Text sources and options: argument words, standard input, files, and a TOML file of options."""

from __future__ import annotations

import sys
import tomllib
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.operators.actions import ExtractionOptions

SCHEMA = "doc_id long, text string"


class UsageError(ValueError):
    """Input that a command cannot use."""


def from_words(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    """One document of words joined by single blanks."""
    return from_text(spark, " ".join(words))


def from_stream(spark: SparkSession, stream: TextIO | None = None) -> DataFrame:
    """One document from a stream, standard input by default."""
    return from_text(spark, (stream or sys.stdin).read())


def from_text(spark: SparkSession, text: str) -> DataFrame:
    if not text.strip():
        raise UsageError("input text is empty")
    return spark.createDataFrame([(0, text)], SCHEMA)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, text)``: one document per UTF-8 file of a path, folder or pattern."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def options_from_toml(path: str) -> ExtractionOptions:
    """Options of the table ``[baseline]`` of a file; unknown keys and wrong types are errors."""
    with open(path, encoding="utf-8") as source:
        return options_from_text(source.read())


def read_options(spark: SparkSession, path: str) -> ExtractionOptions:
    """The same from a file at any path that Spark reads."""
    return options_from_text(spark.read.text(path, wholetext=True).first().value)


def options_from_text(toml: str) -> ExtractionOptions:
    table = tomllib.loads(toml).get("baseline", {})
    if not isinstance(table, dict):
        raise ValueError("[baseline] must be a table")
    if unknown := sorted(table.keys() - {"additional_verbs", "min_confidence"}):
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    verbs = table.get("additional_verbs", [])
    if not isinstance(verbs, list) or any(not isinstance(v, str) for v in verbs):
        raise ValueError("additional_verbs must be an array of strings")
    least = table.get("min_confidence", 0.0)
    if isinstance(least, bool) or not isinstance(least, (int, float)):
        raise ValueError("min_confidence must be a number")
    return ExtractionOptions(tuple(verbs), least)
