"""JSON output of results and reports.

Null actors and patients are kept as null members; UTF-8 is kept as it is. Writing is distributed.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Span members in their order of output.
KEEP_NULLS = {"ignoreNullFields": "false"}


def result_json(results: DataFrame, id_col: str = "doc_id", pretty: bool = False) -> DataFrame:
    """``(id, json)`` of extraction results: text, actions and warnings of each row as one JSON text."""
    options = KEEP_NULLS | ({"pretty": "true"} if pretty else {})
    return results.select(id_col, F.to_json(F.struct("text", "actions", "warnings"), options).alias("json"))


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON record per line, null members kept."""
    results.write.mode(mode).option("ignoreNullFields", "false").json(path)


def report_json(report: dict[str, Any]) -> str:
    """An audit report as text: two blanks of indent, keys in order."""
    return json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False)
