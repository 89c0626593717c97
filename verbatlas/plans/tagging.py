"""Queries of BIO decoding, scoring and example validation, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.operators import bio, evaluate, examples
from verbatlas.session import read


def distinct_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples without what differs between two deliveries of a row."""
    return read(spark, sf_dir, "srl_examples").select(
        "example_id", "document_id", "sentence_id", "split", "words", "predicate_index", "tags", "predicate_roleset"
    ).distinct()


def with_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold tags (repaired, so that they are strict) and predictions made from them by a fixed rule: every
    third word loses its tag, and the other prefixes of words before a lost one become ``I``."""
    rows = distinct_examples(spark, sf_dir).where("tags is not null")
    gold = bio.repair(F.col("tags"))
    pred = F.transform("gold_tags", lambda t, i: F.when(i % 3 == 2, "O").when(i % 3 == 1, bio.continuation(t)).otherwise(t))
    return rows.select("example_id", gold.alias("gold_tags")).withColumn("pred_tags", pred)


def bio_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distinct_examples(spark, sf_dir).select("example_id", F.posexplode(F.arrays_zip(F.col("tags").alias("a"), bio.repair(F.col("tags")).alias("b"))).alias("pos", "t"))
    return rows.where("t.a <> t.b").select("example_id", "pos", F.col("t.a").alias("tag"), F.col("t.b").alias("repaired"))


def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bio.spans_long(bio.decoded(distinct_examples(spark, sf_dir)), "example_id")


def bio_strict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bio.decoded(distinct_examples(spark, sf_dir), repair_tags=False)
    return found.where("error is not null").select("example_id", "error")


def continuation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = distinct_examples(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return tags.select("tag", bio.continuation(F.col("tag")).alias("continuation"), "n")


def span_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_labeled_spans(with_predictions(spark, sf_dir))


def span_prf_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_by_role(with_predictions(spark, sf_dir))


def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.token_accuracy(with_predictions(spark, sf_dir))


def example_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.validated(distinct_examples(spark, sf_dir), with_split=True).where("reason_code is not null").select("example_id", "reason_code")


def example_words_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.tags_long(distinct_examples(spark, sf_dir), "example_id")


def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared examples with a split by a manifest made from the documents' names."""
    prepared = read(spark, sf_dir, "prepared_examples").select("example_id", "document_id").distinct()
    kind = F.substring_index("document_id", "-", 1)
    manifest = prepared.select("document_id").distinct().select(
        "document_id", F.when(kind == "mail", "test").when(kind == "memo", "development").when(kind == "call", "other").otherwise("train").alias("split")
    )
    return examples.with_splits(prepared, manifest)


def spans_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every example in their order, and the first of them."""
    found = bio.decoded(distinct_examples(spark, sf_dir)).select("example_id", bio.in_order(F.col("spans")).alias("s"))
    text = lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"))
    return found.select("example_id", F.array_join(F.transform("s", text), " ").alias("spans"), text(F.array_min("s")).alias("least"))


def queries() -> dict:
    return {f.__name__: f for f in (
        spans_in_order, bio_repair, bio_spans, bio_strict_errors, continuation_tags, span_prf, span_prf_by_role, token_accuracy,
        example_validation, example_words_long, split_assignment,
    )}


BASE = """
WITH ex AS (SELECT DISTINCT example_id, document_id, sentence_id, split, words, predicate_index, tags, predicate_roleset FROM srl_examples),
l0 AS (SELECT example_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM ex),
l1 AS (SELECT *, tag[1:1] AS pre, tag[3:] AS label FROM l0),
l2 AS (SELECT *, lag(pre) OVER w AS ppre, lag(label) OVER w AS plabel FROM l1 WINDOW w AS (PARTITION BY example_id ORDER BY pos)),
rep AS (SELECT *, CASE WHEN pre = 'I' AND NOT (coalesce(ppre, 'O') <> 'O' AND plabel = label) THEN 'B' ELSE pre END AS rpre FROM l2)"""

SPANS = f"""{BASE},
isl AS (SELECT *, sum((rpre <> 'I')::INT) OVER (PARTITION BY example_id ORDER BY pos) AS g FROM rep),
spans AS (SELECT example_id, label, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end" FROM isl WHERE rpre <> 'O' GROUP BY example_id, g, label)"""

PREDICTED = f"""{SPANS},
pt AS (SELECT example_id, pos, CASE WHEN pos % 3 = 2 OR rpre = 'O' THEN 'O' WHEN pos % 3 = 1 THEN 'I' ELSE rpre END AS pre,
  CASE WHEN pos % 3 = 2 OR rpre = 'O' THEN '' ELSE label END AS label, rpre AS gpre, label AS glabel FROM rep),
pl AS (SELECT *, lag(pre) OVER w AS ppre, lag(label) OVER w AS plabel FROM pt WINDOW w AS (PARTITION BY example_id ORDER BY pos)),
pr AS (SELECT *, CASE WHEN pre = 'I' AND NOT (coalesce(ppre, 'O') <> 'O' AND plabel = label) THEN 'B' ELSE pre END AS rpre FROM pl),
pi AS (SELECT *, sum((rpre <> 'I')::INT) OVER (PARTITION BY example_id ORDER BY pos) AS g FROM pr),
pred AS (SELECT example_id, label, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end" FROM pi WHERE rpre <> 'O' GROUP BY example_id, g, label),
g AS (SELECT * FROM spans WHERE label NOT IN ('V', 'C-V')), p AS (SELECT * FROM pred WHERE label NOT IN ('V', 'C-V')),
c AS (SELECT label, sum(tp)::BIGINT AS tp, sum(p)::BIGINT AS p, sum(g)::BIGINT AS g FROM (
  SELECT label, 1 AS tp, 0 AS p, 0 AS g FROM g JOIN p USING (example_id, label, start, "end")
  UNION ALL SELECT label, 0, 1, 0 FROM p UNION ALL SELECT label, 0, 0, 1 FROM g) GROUP BY label)"""

METRICS = """tp AS true_positives, p AS predicted, g AS gold, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS precision,
  CASE WHEN g = 0 THEN 0 ELSE tp / g END AS recall,
  CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / p) * (tp / g) / (tp / p + tp / g) END AS f1"""


def oracle_sql() -> dict[str, str]:
    return {
        "bio_repair": f"{BASE} SELECT example_id, pos::INT AS pos, tag, rpre || '-' || label AS repaired FROM rep WHERE rpre <> pre",
        "bio_spans": f"{SPANS} SELECT * FROM spans",
        "spans_in_order": f"""{SPANS} SELECT ex.example_id, coalesce(string_agg(label || ':' || start || ':' || "end", ' ' ORDER BY label, start, "end"), '') AS spans,
  coalesce(first(label || ':' || start || ':' || "end" ORDER BY label, start, "end"), '') AS least FROM ex LEFT JOIN spans USING (example_id) GROUP BY ex.example_id""",
        "bio_strict_errors": f"""{BASE} SELECT example_id, 'invalid I-tag transition at word ' || min(pos) AS error FROM rep WHERE rpre <> pre GROUP BY example_id""",
        "continuation_tags": f"""{BASE} SELECT tag, CASE WHEN tag = 'O' THEN 'O' ELSE 'I-' || label END AS continuation, count(*)::BIGINT AS n FROM l1 GROUP BY ALL""",
        "span_prf": f"""{PREDICTED}
SELECT {METRICS}, n AS repaired_prediction_tags FROM (SELECT sum(tp)::BIGINT AS tp, sum(p)::BIGINT AS p, sum(g)::BIGINT AS g FROM c),
  (SELECT count(*)::BIGINT AS n FROM pr WHERE pre <> rpre)""",
        "span_prf_by_role": f"{PREDICTED} SELECT label, {METRICS} FROM c",
        "token_accuracy": f"""{PREDICTED} SELECT count(*)::BIGINT AS words, count(*) FILTER (WHERE pre = gpre AND label = glabel)::BIGINT AS correct,
  count(*) FILTER (WHERE pre = gpre AND label = glabel) / count(*) AS accuracy
FROM (SELECT * REPLACE (CASE WHEN gpre = 'O' THEN '' ELSE glabel END AS glabel) FROM pt)""",
        "example_validation": f"""{BASE},
bad AS (SELECT DISTINCT example_id FROM rep WHERE rpre <> pre),
r AS (SELECT ex.example_id, CASE
    WHEN split IS NULL OR split NOT IN ('train', 'development', 'test') THEN 'split_invalid'
    WHEN len(words) = 0 THEN 'words_empty' WHEN len(list_filter(words, lambda w: w IS NULL OR w = '')) > 0 THEN 'word_empty'
    WHEN predicate_index IS NULL OR predicate_index NOT BETWEEN 0 AND len(words) - 1 THEN 'predicate_index_out_of_range'
    WHEN len(tags) <> len(words) THEN 'length_mismatch'
    WHEN len(list_filter(tags, lambda t: NOT regexp_full_match(t, '(?s)O|[BI]-.+'))) > 0 THEN 'tag_invalid'
    WHEN bad.example_id IS NOT NULL THEN 'transition_invalid'
    WHEN tags[predicate_index + 1] <> 'B-V' THEN 'predicate_tag_missing'
    WHEN len(list_filter(tags, lambda t: t = 'B-V')) <> 1 THEN 'predicate_tag_count_invalid'
    WHEN coalesce(trim(predicate_roleset), '') = '' THEN 'roleset_empty' END AS reason_code
  FROM ex LEFT JOIN bad USING (example_id))
SELECT * FROM r WHERE reason_code IS NOT NULL""",
        "example_words_long": f"""{BASE} SELECT example_id, unnest(range(len(words)))::INT AS pos, unnest(words) AS word, unnest(tags) AS tag FROM ex""",
        "split_assignment": """
WITH p AS (SELECT DISTINCT example_id, document_id FROM prepared_examples),
k AS (SELECT *, string_split(document_id, '-')[1] AS kind FROM p)
SELECT example_id, document_id, CASE kind WHEN 'mail' THEN 'test' WHEN 'memo' THEN 'development' WHEN 'call' THEN NULL ELSE 'train' END AS split,
  CASE WHEN kind = 'call' THEN 'split_invalid' END AS split_error FROM k""",
    }
