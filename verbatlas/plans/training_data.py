"""Queries of the general training-data operators (problems 2 and 5) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.operators import skew
from verbatlas.session import read
from verbatlas.sources import records

#: Share of all rows from which a key is heavy.
HEAVY_SHARE = 0.05


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and rolesets that stand in at least 5 % of all rows."""
    return skew.heavy_keys(read(spark, sf_dir, "srl_examples"), ["document_id", "predicate_roleset"], HEAVY_SHARE)


def _profile(spark: SparkSession, sf_dir: str, key: str, category: str) -> DataFrame:
    found = skew.profile(read(spark, sf_dir, "srl_examples"), key, category, F.size("words"), {"median_words": 0.5, "p90_words": 0.9})
    return found.select(F.col("key").alias(key), "rows", F.col("distinct").alias("distinct_values"), F.col("mode").alias("top_value"), "median_words", "p90_words")


def p2_roleset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per roleset: rows, documents, the commonest document, and percentiles of the sentence length."""
    return _profile(spark, sf_dir, "predicate_roleset", "document_id")


def p2_document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: rows, rolesets, the commonest roleset, and percentiles of the sentence length."""
    return _profile(spark, sf_dir, "document_id", "predicate_roleset")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that do not load, with the first reason."""
    return records.parse_records(read(spark, sf_dir, "raw_records")).where("reason is not null").select("line_id", "reason")


def _values(good: DataFrame) -> DataFrame:
    """Loaded records with their words and tags joined by blanks, as no word or tag holds one."""
    joined = {f"n_{c}": F.size(c) for c in ("words", "tags")} | {c: F.array_join(c, " ") for c in ("words", "tags")}
    return good.withColumns(joined)


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed records of the rows that load."""
    return _values(records.split_good_and_bad(records.parse_records(read(spark, sf_dir, "raw_records")))[0].drop("record_no"))


def p5_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows set apart, with reason, place and message."""
    return records.split_good_and_bad(records.parse_records(read(spark, sf_dir, "raw_records")))[1].drop("record_no")


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(batch, part, line)``: texts of the records of a batch, one after the other; a part has the records of 200 numbers."""
    rows = read(spark, sf_dir, "raw_records").where("line is not null")
    part = F.expr("line_id div 200").alias("part")
    return rows.groupBy("batch", part).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_id", "line")))["line"], "\n").alias("line"))


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = record_texts(spark, sf_dir).withColumn("text_id", F.concat_ws(":", "batch", F.col("part").cast("string")))
    return records.parse_records(texts, "line", "text_id", lines=True)


def p5_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that load from texts of many records, resumed at record starts after broken quotes."""
    return _values(records.split_good_and_bad(_recovered(spark, sf_dir), "text_id")[0].drop("record_no"))


def p5_recovery_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not load from texts of many records, with its place in the record."""
    return records.split_good_and_bad(_recovered(spark, sf_dir), "text_id")[1]


def _profile_sql(key: str, category: str) -> str:
    return f"""
WITH r AS (SELECT {key} AS k, {category} AS v, len(words) AS n FROM srl_examples WHERE {key} IS NOT NULL),
c AS (SELECT k, count(*)::BIGINT AS rows, count(DISTINCT v)::BIGINT AS distinct_values FROM r GROUP BY k),
f AS (SELECT k, v, count(*) AS w FROM r WHERE v IS NOT NULL GROUP BY k, v),
t AS (SELECT k, first(v ORDER BY w DESC, v) AS top_value FROM f GROUP BY k),
o AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) AS i, count(*) OVER (PARTITION BY k) AS m FROM r WHERE n IS NOT NULL),
p AS (SELECT k, min(n) FILTER (WHERE i >= 0.5 * m)::INT AS median_words, min(n) FILTER (WHERE i >= 0.9 * m)::INT AS p90_words FROM o GROUP BY k)
SELECT k AS {key}, rows, distinct_values, top_value, median_words, p90_words FROM c LEFT JOIN t USING (k) LEFT JOIN p USING (k)"""


P5_PARSED = r"""
WITH q AS (SELECT line_id, batch, line, regexp_full_match(line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS good FROM raw_records),
f AS (SELECT *, CASE WHEN good THEN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1) END AS raw FROM q),
g AS (SELECT *, list_transform(raw, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE trim(x, E' \t\n\r') END) AS v FROM f),
j AS (SELECT *, CASE
        WHEN line IS NULL THEN 'columns'
        WHEN NOT good THEN 'quoting'
        WHEN len(v) <> 7 THEN 'columns'
        WHEN NOT regexp_full_match(v[5], '[0-9]+') THEN 'predicate_index'
        WHEN v[4] = '' OR v[5]::HUGEINT >= len(string_split(v[4], ' ')) THEN 'predicate_index'
        WHEN NOT regexp_full_match(v[7], '[\pL_-]+\.[0-9][0-9]') THEN 'predicate_roleset' END AS reason FROM g)"""

P5_REJECTED = P5_PARSED + r""",
b AS (SELECT *, length(whole) AS place, line[length(whole) + 1 :] AS rest FROM (SELECT *, CASE WHEN NOT good THEN regexp_extract(line, '^(?:(?:"(?:[^"]|"")*"|[^",]*),)*') END AS whole FROM j WHERE reason IS NOT NULL)),
c AS (SELECT *, regexp_extract(rest, '^"(?:[^"]|"")*"') AS closed, list_transform(range(1, 8), lambda i: coalesce(list_sum(list_transform(raw[1 : i - 1], lambda x: length(x) + 1)), 0)) AS starts FROM b)
SELECT line_id, reason, line AS raw,
  (CASE WHEN line IS NULL THEN 0 WHEN reason = 'columns' THEN starts[least(len(v), 7)] WHEN reason = 'predicate_index' THEN starts[5] WHEN reason = 'predicate_roleset' THEN starts[7]
    WHEN NOT starts_with(rest, '"') THEN place + position('"' IN rest) - 1 WHEN closed = '' THEN place ELSE place + length(closed) END)::INT AS error_at,
  CASE WHEN line IS NULL THEN 'no text' WHEN reason = 'columns' THEN len(v) || ' fields' WHEN reason = 'predicate_roleset' THEN 'not a lemma, a dot and two digits'
    WHEN reason = 'predicate_index' THEN if(regexp_full_match(v[5], '[0-9]+'), 'not below the number of words, ' || if(v[4] = '', 0, len(string_split(v[4], ' '))), 'not only digits')
    WHEN NOT starts_with(rest, '"') THEN 'a quote inside an unquoted field' WHEN closed = '' THEN 'a quoted field without end' ELSE 'text after the end of a quoted field' END AS error FROM c"""

LOADED = """v[1] AS example_id, v[2] AS document_id, v[3] AS sentence_id, v[4] AS words, v[5]::INT AS predicate_index, v[6] AS tags, v[7] AS predicate_roleset,
  len(string_split(v[4], ' '))::INT AS n_words, if(v[6] = '', 0, len(string_split(v[6], ' ')))::INT AS n_tags FROM j WHERE reason IS NULL"""


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_roleset_profile": p2_roleset_profile,
        "p2_document_profile": p2_document_profile,
        "p5_found": p5_found,
        "p5_loaded": p5_loaded,
        "p5_rejected": p5_rejected,
        "p5_recovered": p5_recovered,
        "p5_recovery_errors": p5_recovery_errors,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
SELECT 'document_id' AS key_field, document_id AS key_value FROM srl_examples WHERE document_id IS NOT NULL
GROUP BY document_id HAVING count(*) >= 0.05 * (SELECT count(*) FROM srl_examples)
UNION ALL
SELECT 'predicate_roleset', predicate_roleset FROM srl_examples WHERE predicate_roleset IS NOT NULL
GROUP BY predicate_roleset HAVING count(*) >= 0.05 * (SELECT count(*) FROM srl_examples)""",
        "p2_roleset_profile": _profile_sql("predicate_roleset", "document_id"),
        "p2_document_profile": _profile_sql("document_id", "predicate_roleset"),
        "p5_found": f"{P5_PARSED} SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
        "p5_loaded": f"{P5_PARSED} SELECT line_id, {LOADED}",
        "p5_rejected": P5_REJECTED,
        "p5_recovered": f"{P5_PARSED} SELECT concat_ws(':', batch, (line_id // 200)::VARCHAR) AS text_id, {LOADED}",
    }
