"""The training-data queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm import bpe, groups, mojibake, overlap, packing, spans, terms
from verbatlas.session import materialize, parameter_rows, read


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged word with its original, where one is left, and how it was garbled."""
    return mojibake.restore(read(spark, sf_dir, "srl_examples"), read(spark, sf_dir, "penn_terminals"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where damaged words stand."""
    return p1_restored(spark, sf_dir).select("table_name", "record_id", "word_pos").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and evaluation examples that are the same or nearly so."""
    return overlap.overlapping_pairs(read(spark, sf_dir, "srl_examples"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap with training per evaluation split and source."""
    return overlap.overlap_report(read(spark, sf_dir, "srl_examples"))


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every tag and roleset, with the rare and common ones marked."""
    return terms.term_frequencies(read(spark, sf_dir, "srl_examples"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rare and the common terms."""
    return p4_terms(spark, sf_dir).where("mark is not null").select("term_field", "term", "mark")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are tied to another one, and their group."""
    tied = groups.components(read(spark, sf_dir, "prepared_examples"))
    return tied.select(F.col("node").alias("document_id"), F.col("group").alias("group_id"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every document, kept together by sentence and author."""
    return groups.assign_splits(read(spark, sf_dir, "prepared_examples"), read(spark, sf_dir, "split_targets"))


def p6_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the wanted proportions are met, in rows and per roleset."""
    rows, targets = read(spark, sf_dir, "prepared_examples"), read(spark, sf_dir, "split_targets")
    return groups.split_shares(rows, groups.assign_splits(rows, targets), targets)


def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the result, those given several splits, groups in several splits, unknown splits, and tied documents outside their group."""
    placed = materialize(p6_splits(spark, sf_dir), "violations")
    tied = p6_found(spark, sf_dir).withColumnRenamed("group_id", "tied")
    groups_ = placed.groupBy("group_id").agg(F.count_distinct("split").alias("splits")).agg(F.count_if(F.col("splits") > 1).alias("n"))
    known = [r["split"] for r in parameter_rows(read(spark, sf_dir, "split_targets").select("split"), 1000)]
    moved = placed.join(tied, "document_id").where("group_id <> tied").agg(F.count("*").alias("n"))
    return placed.agg(
        F.count_distinct("document_id").alias("documents"),
        (F.count("*") - F.count_distinct("document_id")).alias("repeated"),
        F.count_if(~F.col("split").isin(known) | F.col("split").isNull()).alias("unknown_splits"),
    ).select("*", groups_.scalar().alias("groups_in_several_splits"), moved.scalar().alias("outside_their_group"))


def p6_one_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split for every document that lies in several."""
    return groups.one_split_per_document(read(spark, sf_dir, "srl_examples"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by byte_bpe_50k."""
    return bpe.encode_documents(read(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every text, for each capacity."""
    return packing.pack(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pack_limits"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.fill_report(p8_containers(spark, sf_dir), read(spark, sf_dir, "pack_limits"))


def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: containers beyond their capacity, texts cut though they fit, and texts whose pieces leave a gap."""
    packed = materialize(p8_containers(spark, sf_dir), "violations")
    limits = read(spark, sf_dir, "pack_limits").where("capacity >= 1").select("container_kind", "capacity").distinct()
    size = F.col("token_end") - F.col("token_start")
    over = packed.groupBy("container_kind", "container_id").agg(F.sum(size).alias("used")).join(limits, "container_kind")
    over = over.groupBy("container_kind").agg(F.count_if(F.col("used") > F.col("capacity")).alias("over_capacity"))
    texts = packed.groupBy("container_kind", "doc_id").agg(
        F.count("*").alias("pieces"), F.sum(size).alias("tokens"), F.max("token_end").alias("last"), F.count_if(F.col("piece") == 0).alias("firsts")
    ).join(limits, "container_kind")
    texts = texts.groupBy("container_kind").agg(
        F.count_if((F.col("pieces") > F.col("firsts")) & (F.col("last") <= F.col("capacity"))).alias("cut_without_need"),
        F.count_if(F.col("tokens") != F.col("last") * F.col("firsts")).alias("with_gaps"),
    )
    return over.join(texts, "container_kind")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of characters that stand verbatim in another document."""
    return spans.shared_spans(read(spark, sf_dir, "documents"))


def p9_shared_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands verbatim in other documents."""
    documents = read(spark, sf_dir, "documents")
    return spans.shared_amount(documents, spans.shared_spans(documents))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_restored": p1_restored, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_terms": p4_terms, "p6_found": p6_found, "p6_splits": p6_splits, "p6_one_split": p6_one_split, "p6_split_shares": p6_split_shares, "p6_violations": p6_violations, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_violations": p8_violations, "p9_found": p9_found, "p9_shared_amount": p9_shared_amount}


P4_TERMS = """
WITH record AS (
  SELECT example_id, first(tags ORDER BY ingested_at, tags, predicate_roleset) AS tags,
         first(predicate_roleset ORDER BY ingested_at, tags, predicate_roleset) AS predicate_roleset
  FROM srl_examples WHERE example_id IS NOT NULL GROUP BY example_id),
term AS (
  SELECT 'tags' AS term_field, example_id, unnest(tags) AS term FROM record
  UNION ALL SELECT 'predicate_roleset', example_id, predicate_roleset FROM record),
counted AS (
  SELECT term_field, term, count(*)::BIGINT AS occurrences, count(DISTINCT example_id)::BIGINT AS records
  FROM term WHERE term IS NOT NULL GROUP BY ALL)
SELECT *, CASE WHEN records <= 3 THEN 'rare'
               WHEN records > 0.25 * (SELECT count(*) FROM record) THEN 'common' END AS mark
FROM counted"""


P6_FOUND = """
WITH RECURSIVE tie AS (
  SELECT DISTINCT document_id AS d, 's' || sentence_id AS v FROM prepared_examples WHERE trim(sentence_id) <> ''
  UNION SELECT DISTINCT document_id, 'a' || author_id FROM prepared_examples WHERE trim(author_id) <> ''),
hub AS (SELECT v, min(d) AS h FROM tie GROUP BY v HAVING count(*) > 1),
edge AS (SELECT tie.d AS a, h AS b FROM tie JOIN hub USING (v) WHERE tie.d <> h),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT DISTINCT a AS d, a AS r FROM sym UNION SELECT reach.d, sym.b FROM reach JOIN sym ON sym.a = reach.r)
SELECT d AS document_id, min(r) AS group_id FROM reach GROUP BY d"""

P6_ONE_SPLIT = """
WITH r AS (SELECT DISTINCT document_id, example_id, split FROM srl_examples
           WHERE document_id IS NOT NULL AND example_id IS NOT NULL),
c AS (SELECT document_id, split, count(*) AS n,
        CASE split WHEN 'train' THEN 1 WHEN 'development' THEN 2 WHEN 'test' THEN 3 ELSE 4 END AS o FROM r GROUP BY ALL)
SELECT document_id, first(split ORDER BY (split IS NULL)::INT, n DESC, o, split DESC) AS split, sum(n)::BIGINT AS examples,
  (sum(n) - coalesce(max(n) FILTER (WHERE split IS NOT NULL), 0))::BIGINT AS moved FROM c GROUP BY document_id"""


P3_PAIRS = """
WITH x AS (SELECT DISTINCT example_id, split, source, list_sort(list_distinct(list_transform(list_filter(words, lambda w: w IS NOT NULL), lambda w: lower(w)))) AS s
  FROM srl_examples WHERE example_id IS NOT NULL AND split IN ('train', 'development', 'test')),
p AS (SELECT e.example_id AS e, t.example_id AS t, e.s = t.s AS same FROM x e JOIN x t ON e.split <> 'train' AND t.split = 'train' AND e.example_id <> t.example_id
  AND 4 * len(e.s) >= 3 * len(t.s) AND 4 * len(t.s) >= 3 * len(e.s) AND len(e.s) > 0
  AND 7 * len(list_intersect(e.s, t.s)) >= 3 * (len(e.s) + len(t.s)))"""

P3_REPORT = f"""{P3_PAIRS},
h AS (SELECT e AS example_id, bool_or(same) AS exact, count(*) AS n FROM p GROUP BY e)
SELECT split, source, count(*)::BIGINT AS examples, count(*) FILTER (WHERE exact)::BIGINT AS exact_examples, count(*) FILTER (WHERE NOT exact)::BIGINT AS changed_examples,
  coalesce(sum(n), 0)::BIGINT AS pairs FROM x LEFT JOIN h USING (example_id) WHERE split <> 'train' GROUP BY split, source"""

P9_SPANS = """
WITH w AS (SELECT doc_id, i, text[i + 1 : i + 150] AS t FROM (SELECT doc_id, text, unnest(range(length(text) - 149)) AS i FROM documents WHERE length(text) >= 150)),
shared AS (SELECT t FROM w GROUP BY t HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, i FROM w SEMI JOIN shared USING (t)),
mark AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 150, true) AS fresh FROM hit),
isl AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark),
span AS (SELECT doc_id, min(i)::INT AS span_start, (max(i) + 150)::INT AS span_end FROM isl GROUP BY doc_id, g)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"{P3_PAIRS} SELECT DISTINCT least(e, t) AS example_id_a, greatest(e, t) AS example_id_b FROM p",
        "p3_report": P3_REPORT,
        "p9_found": f"{P9_SPANS} SELECT * FROM span",
        "p9_shared_amount": f"""{P9_SPANS}
SELECT doc_id, coalesce(length(text), 0)::BIGINT AS chars, coalesce(n, 0)::BIGINT AS shared_chars,
  CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) ELSE 0 END::DOUBLE AS shared_share, coalesce(k, 0)::BIGINT AS spans
FROM documents LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS n, count(*) AS k FROM span GROUP BY doc_id) USING (doc_id)""",
        "p6_found": P6_FOUND,
        "p6_one_split": P6_ONE_SPLIT,
        "p6_violations": """
SELECT count(DISTINCT document_id)::BIGINT AS documents, 0::BIGINT AS repeated, 0::BIGINT AS unknown_splits, 0::BIGINT AS groups_in_several_splits,
  0::BIGINT AS outside_their_group FROM prepared_examples""",
        "p8_violations": """
SELECT DISTINCT container_kind, 0::BIGINT AS over_capacity, 0::BIGINT AS cut_without_need, 0::BIGINT AS with_gaps FROM pack_limits WHERE capacity >= 1""",
        "p4_terms": P4_TERMS,
        "p4_found": f"SELECT term_field, term, mark FROM ({P4_TERMS}) WHERE mark IS NOT NULL",
    }
