"""Queries of layer joins, duplicate predicates and inventories, and their SQL twins.

The three layers are the documents of ``srl_examples`` (text), ``penn_terminals`` (ptb) and the examples with a known
roleset (prop); calls and minutes are spoken, other kinds written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.operators import audit
from verbatlas.session import read


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = read(spark, sf_dir, "srl_examples").select("document_id", "predicate_roleset")
    sides = {
        "text": examples.select("document_id"),
        "ptb": read(spark, sf_dir, "penn_terminals").select("document_id"),
        "prop": examples.where("predicate_roleset is not null").select("document_id"),
    }
    spoken = F.substring_index("document_id", "-", 1).isin("call", "minutes")
    each = [df.where("document_id is not null").distinct().select(F.lit(n).alias("layer"), "document_id") for n, df in sides.items()]
    genre = F.when(spoken & ~((F.col("layer") == "ptb") & F.col("document_id").endswith("7")), "spoken").otherwise("written")
    return reduce(DataFrame.unionByName, each).withColumn("genre", genre).withColumn("path", F.concat_ws("/", "layer", "genre", "document_id"))


def layer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.complete_documents(layers(spark, sf_dir)).select("document_id", F.array_join("genres", "+").alias("genres"), "conflict")


def missing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_layers(layers(spark, sf_dir))


def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.layer_summary(layers(spark, sf_dir))


def duplicate_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user in one bucket of ten are predicates of one sentence; later ones are duplicates."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 10).alias("bucket"), F.col("event_type").alias("raw"))
    found = audit.duplicate_predicates(rows, ["user_id", "bucket"], "event_id", "raw")
    return found.where("duplicate is not null").groupBy("user_id", "duplicate").agg(F.count("*").alias("rows"))


#: Rows as archives have them, typed and classic, good and bad, without their two indexes.
ROW_ENDS = (
    "gold go-v go.01 ----- 0:1-ARG0 1:0-rel", "gold go-n go.01 ----- 0:1-ARG0 1:0-rel", "gold go.01 vp--a 0:1-ARG0 1:0,2:0-rel 3:1*4:0-ARG1", "gold go-a go.01 ----- 0:1-ARG0 bad", "gold go-v go.01 ----- 1:0-rel 0:1*2:2-LINK-PCR 2:2-R-ARG0",
    "gold go.01 vp--a 0:1-C-ARG0", "gold go-v go.01 -----", "gold go-v go01 ----- 1:0-rel", "gold go.01 vp-a 1:0-rel", "gold go-v go.01 ----- 1:0-rel 2:0-rel", "gold go.01 vp--a", "gold go-v go.01 --- 1:0-rel", "gold go-x go.01 ----- 1:0-rel",
    "gold go-v go.01 ----- 0:1;2:0-ARG0 1:0;3:0-rel 4:0,5:0*6:0-C-ARG0", "gold", "gold go-v go.01 ----- 1:0-rel 2:0-LINK-SLC 3:0*4:0-LINK-SLC",
)


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as an archive has them, made from events."""
    n = F.col("event_id")
    head = F.when(n % 17 == 3, "x 1").when(n % 17 == 5, "-1 1").otherwise(F.concat_ws(" ", (n % 7).cast("string"), (n % 5).cast("string")))
    end = F.element_at(F.array(*map(F.lit, ROW_ENDS)), (n % len(ROW_ENDS)).cast("int") + 1)
    return read(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", head, end).alias("row"))


def local_record_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.local_records(archive_rows(spark, sf_dir))
    return found.groupBy("kind", "dialect", "row_error").agg(F.count("*").alias("rows"), F.sum("n_rel").cast("long").alias("rels"))


def annotation_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.annotation_inventory(archive_rows(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (layer_join, missing_layers, layer_summary, duplicate_predicates, local_record_reasons, annotation_inventory)}


LAYERS = """
WITH d AS (SELECT DISTINCT 'text' AS layer, document_id FROM srl_examples
  UNION SELECT 'ptb', document_id FROM penn_terminals UNION SELECT 'prop', document_id FROM srl_examples WHERE predicate_roleset IS NOT NULL),
l AS (SELECT *, CASE WHEN string_split(document_id, '-')[1] IN ('call', 'minutes') AND NOT (layer = 'ptb' AND document_id LIKE '%7') THEN 'spoken' ELSE 'written' END AS genre
  FROM d WHERE document_id IS NOT NULL)"""


LABEL = "[0-9]+:[0-9]+(?:[,;*][0-9]+:[0-9]+)*-(.+)"

#: Archive rows taken apart: fields, type, dialect and label fields.
ARCHIVE_ROWS = f"""
WITH a AS (SELECT event_id, CASE event_id % 17 WHEN 3 THEN 'x 1' WHEN 5 THEN '-1 1' ELSE (event_id % 7) || ' ' || (event_id % 5) END || ' ' || [{", ".join(f"'{e}'" for e in ROW_ENDS)}][event_id % {len(ROW_ENDS)} + 1] AS row FROM events),
f0 AS (SELECT *, string_split(row, ' ') AS f FROM a),
f1 AS (SELECT *, coalesce(f[6] = '-----', false) AS dashes, coalesce(regexp_full_match(f[4], '.+-[anv]'), false) AS typed, try_cast(f[1] AS INT) AS si, try_cast(f[2] AS INT) AS pi FROM f0),
f2 AS (SELECT *, if(dashes AND typed, right(f[4], 1), 'classic') AS kind, len(f) >= 7 AND typed AND coalesce(contains(f[5], '.'), false) AND dashes AS modern, len(f) >= 6 AND coalesce(contains(f[4], '.'), false) AND coalesce(length(f[5]), 0) = 5 AS classic FROM f1),
r AS (SELECT *, if(modern, f[7:], f[6:]) AS labels FROM f2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "layer_join": f"""{LAYERS} SELECT document_id, string_agg(DISTINCT genre, '+' ORDER BY genre) AS genres, count(DISTINCT genre) > 1 AS conflict
FROM l GROUP BY document_id HAVING count(DISTINCT layer) = 3""",
        "missing_layers": f"""{LAYERS} SELECT n.layer, u.document_id FROM (SELECT DISTINCT document_id FROM l) u, (VALUES ('text'), ('ptb'), ('prop')) n(layer)
EXCEPT SELECT layer, document_id FROM l""",
        "layer_summary": f"""{LAYERS} SELECT layer, count(*)::BIGINT AS files, count(DISTINCT document_id)::BIGINT AS canonical_documents,
count(*) FILTER (WHERE genre = 'spoken')::BIGINT AS spoken_files, count(*) FILTER (WHERE genre = 'written')::BIGINT AS written_files,
count(*) FILTER (WHERE lower(document_id) LIKE 'wsj\\_%' ESCAPE '\\')::BIGINT AS wsj_files FROM l GROUP BY layer""",
        "duplicate_predicates": """
WITH e AS (SELECT *, first_value(event_type) OVER w AS f, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_id % 10 ORDER BY event_id))
SELECT user_id, CASE WHEN f = event_type THEN 'exact' ELSE 'conflicting' END AS duplicate, count(*)::BIGINT AS rows FROM e WHERE n > 1 AND user_id IS NOT NULL GROUP BY ALL""",
        "local_record_reasons": f"""{ARCHIVE_ROWS},
g AS (SELECT *, len(list_filter(if(kind = 'classic', f[6:], f[7:]), lambda x: regexp_full_match(x, '{LABEL}') AND regexp_extract(x, '^{LABEL}$', 1) = 'rel')) AS n_rel,
  CASE WHEN si IS NULL OR pi IS NULL THEN 'record_fixed_fields_invalid' WHEN si < 0 OR pi < 0 THEN 'record_index_negative' WHEN NOT modern AND NOT classic THEN 'record_fixed_fields_invalid'
    WHEN len(labels) = 0 OR len(list_filter(labels, lambda x: NOT regexp_full_match(x, '{LABEL}'))) > 0 THEN 'record_label_field_invalid'
    WHEN len(list_filter(labels, lambda x: regexp_extract(x, '^{LABEL}$', 1) = 'rel')) <> 1 THEN 'record_rel_count_invalid' END AS row_error FROM r)
SELECT kind, if(kind = 'classic', 'classic', 'modern') AS dialect, row_error, count(*)::BIGINT AS rows, sum(n_rel)::BIGINT AS rels FROM g GROUP BY ALL""",
        "annotation_inventory": f"""{ARCHIVE_ROWS},
x AS (SELECT event_id, ok, p, l FROM (SELECT event_id, regexp_full_match(t, '{LABEL}') AS ok, regexp_extract(t, '^([0-9:,;*]+)-', 1) AS p, regexp_extract(t, '^{LABEL}$', 1) AS l FROM (SELECT event_id, unnest(if(dashes, f[7:], f[6:])) AS t FROM r))),
used AS (SELECT event_id, bool_or(ok AND contains(p, ',')) AS comma, bool_or(ok AND contains(p, ';')) AS semicolon, bool_or(ok AND contains(p, '*')) AS star FROM x GROUP BY event_id),
i AS (SELECT if(dashes, 'dialect_modern', 'dialect_classic') AS item FROM r UNION ALL SELECT 'predicate_type_' || kind FROM r WHERE dashes
  UNION ALL SELECT 'records_' || coalesce(nullif(concat_ws('+', CASE WHEN comma THEN 'comma' END, CASE WHEN semicolon THEN 'semicolon' END, CASE WHEN star THEN 'star' END), ''), 'simple') FROM r LEFT JOIN used USING (event_id)
  UNION ALL SELECT CASE WHEN NOT ok THEN 'unparsed_label_fields' WHEN starts_with(l, 'LINK-') THEN 'link_' || l WHEN starts_with(l, 'C-') THEN 'continuation_labels' WHEN starts_with(l, 'R-') THEN 'reference_labels' END FROM x
  UNION ALL SELECT 'pointer_fields_comma' FROM x WHERE ok AND contains(p, ',') UNION ALL SELECT 'pointer_fields_semicolon' FROM x WHERE ok AND contains(p, ';') UNION ALL SELECT 'pointer_fields_star' FROM x WHERE ok AND contains(p, '*')
  UNION ALL SELECT 'multi_pointer_predicates' FROM x WHERE l = 'rel' AND regexp_matches(p, '[,;*]'))
SELECT item, count(*)::BIGINT AS n FROM i WHERE item IS NOT NULL GROUP BY item""",
    }
