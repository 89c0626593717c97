"""Streaming forms: frames of arriving texts, and damaged records set apart while the good ones are loaded.

Extraction is an expression on the row of a document, so it runs on a stream without state, watermark or shuffle.
Counts per lemma keep one counter per lemma and time window; windows older than the watermark are final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.operators.actions import ExtractionOptions, action_frames, predicate_candidates
from verbatlas.sources.records import parse_records


def frame_stream(documents: DataFrame, options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
    """Action frames of a stream of ``(doc_id, text)``; append mode."""
    return action_frames(documents, options)


def lemma_counts(documents: DataFrame, time_col: str, late: str = "1 hour", window: str = "1 day", options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
    """``(window, lemma, candidates)`` of a stream with event times; rows later than ``late`` are left out."""
    keyed = documents.withColumn("_key", F.struct(F.col("doc_id").alias("doc_id"), F.col(time_col).cast("timestamp").alias("at")))
    found = predicate_candidates(keyed, options, id_col="_key").withColumn("at", F.col("_key.at"))
    return found.withWatermark("at", late).groupBy(F.window("at", window), "lemma").agg(F.count("*").alias("candidates"))


def record_stream(lines: DataFrame) -> DataFrame:
    """Typed records and rejects of a stream of ``(line_id, line)``; ``reason`` tells them apart."""
    return parse_records(lines)
