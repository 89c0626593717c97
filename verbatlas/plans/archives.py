"""Queries of archive audits, and their SQL twins.

The archives are made from the documents of ``srl_examples``: every document gives a text, a tree file and a record
file, written into ZIP archives with what real ones have too: missing and repeated layers, other encodings, broken
trees, bad and repeated rows, denied documents, unsafe and damaged members. The queries read these archives back; the
twins compute from the tables what must be found.
"""

from __future__ import annotations

import io
import warnings
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.operators import audit
from verbatlas.session import materialize, read, ship
from verbatlas.sources import archive

TREE = "( (S (NP-SBJ (NNP Ines)) (VP (VBD shipped) (NP (-NONE- *PRO*)) (NP (DT the) (NN crate))) (. .)) )"

#: Members beside the layers: path, external attributes, kind.
EXTRAS = (
    ("Propbank/README.txt", 0, ""), ("Propbank/Readme.TXT", 0, ""), ("Propbank/LICENSE", 0, ""), ("Propbank/Propbank-orig/framefiles/license-v.txt", 0, ""), ("Propbank/Propbank-orig/framefiles/notice.txt", 0, ""),
    ("../up.txt", 0, ""), ("C:/abs.txt", 0, ""), ("a\\b.txt", 0, ""), ("/root.txt", 0, ""), ("Propbank/link", 0o120777 << 16, ""), ("Propbank/secret.bin", 0, "encrypted"), ("Propbank/bad.bin", 0, "damaged"),
    ("Propbank/.svn/entries", 0, ""), ("Propbank/empty/", 0, ""), ("Propbank/MASC1_textfiles/other/x.txt", 0, ""), ("Propbank/MASC1_textfiles/written/deep/x.txt", 0, ""), ("Propbank/NOTICE", 0, ""), ("Propbank/NOTICE", 0, ""),
)


def zipped(members: DataFrame) -> DataFrame:
    """``(path, content)`` of one archive for each ``archive`` of ``(archive, path, content, attributes, kind)``."""
    ship(members.sparkSession)

    def one(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made, warnings.catch_warnings():
            warnings.simplefilter("ignore")  # of repeated names
            for path, content, attributes, kind in zip(*(table.column(n).to_pylist() for n in ("path", "content", "attributes", "kind"))):
                info = zipfile.ZipInfo(path)
                made.writestr(info, content or b"")
                info.external_attr = attributes
                info.flag_bits |= kind == "encrypted"
                info.CRC ^= kind == "damaged"
        return pa.table({"path": [f"{table.column('archive')[0].as_py()}.zip"], "content": pa.array([out.getvalue()], pa.binary())})

    return members.groupBy("archive").applyInArrow(one, "path string, content binary")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(d, num, genre, other)`` of the documents: name, number, genre folder and the other one."""
    rows = read(spark, sf_dir, "srl_examples").where("document_id is not null").select("document_id").distinct()
    num = F.coalesce(F.element_at(F.split("document_id", "-"), -1).try_cast("int"), F.lit(0))
    spoken = F.element_at(F.split("document_id", "-"), 1).isin("call", "minutes")
    return rows.select(F.concat(F.when(num % 17 == 0, "wsj_").otherwise(""), "document_id").alias("d"), num.alias("num"), F.when(spoken, "spoken").otherwise("written").alias("genre"), F.when(spoken, "written").otherwise("spoken").alias("other"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of all archives, before they are packed; an archive holds the documents of 50 numbers."""
    k, n = F.col("num") % 13, F.col("num") % 3 + 1
    rows = documents(spark, sf_dir)
    path = lambda layer, genre, end: F.concat(F.lit(audit.PREFIXES[layer]), genre, F.lit("/"), "d", F.lit(end))
    text = F.concat("d", F.lit(" café "), F.repeat(F.lit("x"), 1 + F.char_length("d") % 2))
    encoded = (
        F.when(F.col("num") % 4 == 0, F.encode(text, "utf-8")).when(F.col("num") % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "utf-8")))
        .when(F.col("num") % 4 == 2, F.encode(text, "utf-16")).otherwise(F.encode(text, "iso-8859-1"))
    )
    trees = F.encode(F.concat(F.repeat(F.lit(TREE + "\n"), n), F.when(F.col("num") % 29 == 0, "(").otherwise("")), "utf-8")
    row = lambda s: F.concat(s.cast("string"), F.lit(" 1 gold ship-v ship.01 ----- 0:1-ARG0 1:0-rel "), F.when(k == 5, "2:1-ARG1").otherwise("3:1-ARG1"))
    extra = (
        F.when(k == 1, "77 1 gold ship-v ship.01 ----- 1:0-rel").when(k == 2, row(F.lit(0))).when(k == 4, "0 1 gold ship-v ship.02 ----- 1:0-rel").when(k == 6, "0 9 gold ship-v ship.01 ----- 9:0-rel")
        .when(k == 8, "x 1 gold ship-v ship.01 ----- 1:0-rel").when(k == 11, "0 4 gold crate-n crate.01 ----- 4:0-rel").when(k == 12, "0 3 gold ship.01 vp--a 3:0-rel 0:1*2:1-ARG1")
    )
    lines = F.array_join(F.array_compact(F.concat(F.transform(F.sequence(F.lit(0), n - 1), row), F.array(extra))), "\n")
    record = lambda more: F.encode(F.concat(lines, F.lit(more)), "utf-8")
    file = lambda test, layer, genre, end, content: F.when(test, F.struct(path(layer, genre, end).alias("path"), content.alias("content")))
    genre, other = F.col("genre"), F.col("other")
    files = F.array_compact(F.array(
        file(k != 3, "text", genre, ".txt", encoded),
        file(F.col("num") % 19 != 0, "ptb", F.when(k == 7, other).otherwise(genre), ".mrg", trees), file((k == 9) & (F.col("num") % 19 != 0), "ptb", genre, ".mrg.txt", trees),
        file(k != 10, "prop", genre, ".prop", record("\n")), file(k == 0, "prop", other, ".prop", record("\n")), file((F.col("num") % 23 == 0) & (k != 0) & (k != 10), "prop", other, ".prop", record("\n\n0 1 gold")),
    ))
    layers = rows.select(F.floor(F.col("num") / 50).cast("int").alias("archive"), F.explode(files).alias("f")).select("archive", "f.path", "f.content", F.lit(0).cast("long").alias("attributes"), F.lit("").alias("kind"))
    extras = spark.createDataFrame([(0, p, b"x" if not p.endswith("/") else b"", a, kind) for p, a, kind in EXTRAS], "archive int, path string, content binary, attributes long, kind string")
    return layers.unionByName(extras)


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members as read back from the archives."""
    return archive.members_of(materialize(zipped(members(spark, sf_dir)), "archives"))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = documents(spark, sf_dir)
    families = docs.where("num % 5 <> 0").select(F.col("d").alias("document_id"), F.substring_index("d", "-", 1).alias("family"))
    return audit.audit_tables(archived(spark, sf_dir), docs.where("num % 10 <> 9").select(F.col("d").alias("document_id")), families)


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member with its layer, genre, document and marks."""
    rows = audit.classified(archived(spark, sf_dir))
    return rows.select("archive", "path", "is_dir", "clean", "layer", "genre", "document_id", "unsafe", "symlink", "encrypted", (~F.coalesce("crc_ok", F.lit(True))).alias("damaged"))


def archive_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with the encodings that they were read in."""
    rows = archive.decoded(audit.classified(archived(spark, sf_dir)).where("layer = 'text' and genre is not null").select("document_id", "content"))
    return rows.select("document_id", "encoding", "text")


def archive_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.safety_facts(audit.classified(archived(spark, sf_dir))).drop("compressed_bytes", "uncompressed_bytes")


def archive_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.problem_paths(audit.classified(archived(spark, sf_dir)))


def archive_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.notices(audit.classified(archived(spark, sf_dir)))


def archive_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.suffix_counts(audit.classified(archived(spark, sf_dir)))


def archive_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.duplicate_names(audit.layer_files(audit.classified(archived(spark, sf_dir))))
    return found.withColumn("names", F.array_join("names", " "))


def archive_layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.layer_summary(audit.layer_files(audit.classified(archived(spark, sf_dir))))


def archive_missing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_layers(audit.layer_files(audit.classified(archived(spark, sf_dir))))


def archive_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record file taken for each document."""
    return tables(spark, sf_dir)["chosen"].select("document_id", "path", "alternates", "ambiguous")


def archive_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["scan"].select("document_id", "sentences", F.array_join(F.transform("terminals", lambda n: n.cast("string")), " ").alias("terminals"), "tree_error")


def archive_join_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record row of the archives, why it meets no tree, and whether it repeats another."""
    return tables(spark, sf_dir)["full"].select("document_id", "line_no", "row", "sentence_index", "predicate_index", "kind", "n_rel", "row_error", "reason", "duplicate")


def archive_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["exclusions"].select("document_id", F.array_join("reasons", " ").alias("reasons"), "n")


def archive_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["retained"].select("document_id", "line_no", "row")


def archive_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["converted"].select("raw_line", "reason_code", F.array_join("tags", " ").alias("tags"))


def archive_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["findings"]


def archive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.annotation_inventory(tables(spark, sf_dir)["retained"])


def archive_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["rights"].groupBy("family", "disposition").agg(F.count("*").alias("documents"))


def archive_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates and the decision, of an archive that is taken as pinned."""
    t = tables(spark, sf_dir)
    done = t["converted"].agg(F.count("*").alias("n"), F.count_if(F.col("reason_code").isNull()).alias("good")).first()
    retained = t["retained"].agg(F.count_distinct("document_id")).first()[0]
    gates = audit.gates_of(audit.safety_facts(t["rows"]).first().asDict(), True, t["exclusions"].count(), retained, done.good / done.n if done.n else 0.0)
    return spark.createDataFrame([(*gates.values(), audit.decision_of(gates))], ", ".join([*(f"{g} boolean" for g in gates), "decision string"]))


def queries() -> dict:
    return {f.__name__: f for f in (
        archive_members, archive_decoding, archive_safety, archive_problems, archive_notices, archive_suffixes, archive_duplicate_names, archive_layer_summary, archive_missing_layers, archive_record_files,
        archive_tree_scan, archive_join_rows, archive_exclusions, archive_retained, archive_conversion, archive_findings, archive_inventory, archive_rights, archive_gates,
    )}


_EXTRAS = ", ".join(f"(0, '{p}', {a}, '{k}')" for p, a, k in EXTRAS)

FILES = f"""
WITH doc AS (SELECT if(num % 17 = 0, 'wsj_', '') || document_id AS d, num, num % 13 AS k, num % 3 + 1 AS n, if(spoken, 'spoken', 'written') AS genre, if(spoken, 'written', 'spoken') AS other
  FROM (SELECT DISTINCT document_id, coalesce(try_cast(string_split(document_id, '-')[-1] AS INT), 0) AS num, string_split(document_id, '-')[1] IN ('call', 'minutes') AS spoken FROM srl_examples WHERE document_id IS NOT NULL)),
member AS (SELECT num // 50 AS archive, 'Propbank/MASC1_textfiles/' || genre || '/' || d || '.txt' AS path, 0 AS attributes, '' AS kind FROM doc WHERE k <> 3
  UNION ALL SELECT num // 50, 'Propbank/Penn_Treebank-orig/data/' || if(k = 7, other, genre) || '/' || d || '.mrg', 0, '' FROM doc WHERE num % 19 <> 0
  UNION ALL SELECT num // 50, 'Propbank/Penn_Treebank-orig/data/' || genre || '/' || d || '.mrg.txt', 0, '' FROM doc WHERE num % 19 <> 0 AND k = 9
  UNION ALL SELECT num // 50, 'Propbank/Propbank-orig/data/' || genre || '/' || d || '.prop', 0, '' FROM doc WHERE k <> 10
  UNION ALL SELECT num // 50, 'Propbank/Propbank-orig/data/' || other || '/' || d || '.prop', 0, '' FROM doc WHERE k = 0 OR num % 23 = 0 AND k <> 10
  UNION ALL SELECT * FROM (VALUES {_EXTRAS})),
m AS (SELECT *, NOT ends_with(path, '/') AND NOT contains(path, '/.svn/') AS clean, string_split(path, '/')[-1] AS name FROM member),
m2 AS (SELECT *, CASE WHEN NOT clean THEN NULL WHEN regexp_matches(path, '^Propbank/MASC1_textfiles/.*\\.txt$') THEN 'text' WHEN regexp_matches(path, '^Propbank/Penn_Treebank-orig/data/.*\\.mrg(\\.txt)?$') THEN 'ptb'
    WHEN regexp_matches(path, '^Propbank/Propbank-orig/data/.*\\.prop$') THEN 'prop' END AS layer FROM m),
m3 AS (SELECT *, CASE WHEN layer IS NOT NULL THEN nullif(regexp_extract(path, '/(?:MASC1_textfiles|data)/(spoken|written)/[^/]+$', 1), '') END AS genre, CASE WHEN layer IS NOT NULL THEN regexp_replace(name, '\\.txt$|\\.mrg$|\\.mrg\\.txt$|\\.prop$', '') END AS document_id,
    starts_with(path, '/') OR contains(path, '\\') OR regexp_matches(path, '(^|/)\\.\\.(/|$)') OR regexp_matches(path, '^[A-Za-z]:') AS unsafe, attributes = {0o120777 << 16} AS symlink, kind = 'encrypted' AS encrypted, kind = 'damaged' AS damaged FROM m2),
f AS (SELECT layer, genre, document_id, path, name FROM m3 WHERE layer IS NOT NULL AND genre IS NOT NULL),
presence AS (SELECT document_id, count(DISTINCT layer) AS layers, count(DISTINCT genre) > 1 AS conflict, count(*) FILTER (WHERE layer = 'ptb') AS ptb_files, count(*) FILTER (WHERE layer = 'text') AS text_files, count(*) FILTER (WHERE layer = 'prop') AS prop_files FROM f GROUP BY document_id)"""

ROWS = FILES + f""",
line AS (SELECT d, num, k, n, i::INT AS line_no, i || ' 1 gold ship-v ship.01 ----- 0:1-ARG0 1:0-rel ' || if(k = 5, '2:1-ARG1', '3:1-ARG1') AS row FROM doc, unnest(range(n)) r(i)
  UNION ALL SELECT d, num, k, n, n::INT, CASE k WHEN 1 THEN '77 1 gold ship-v ship.01 ----- 1:0-rel' WHEN 2 THEN '0 1 gold ship-v ship.01 ----- 0:1-ARG0 1:0-rel 3:1-ARG1' WHEN 4 THEN '0 1 gold ship-v ship.02 ----- 1:0-rel'
    WHEN 6 THEN '0 9 gold ship-v ship.01 ----- 9:0-rel' WHEN 8 THEN 'x 1 gold ship-v ship.01 ----- 1:0-rel' WHEN 11 THEN '0 4 gold crate-n crate.01 ----- 4:0-rel' ELSE '0 3 gold ship.01 vp--a 3:0-rel 0:1*2:1-ARG1' END FROM doc WHERE k IN (1, 2, 4, 6, 8, 11, 12)),
chosen AS (SELECT d AS document_id, if(num % 23 = 0 AND k <> 0, NULL, 'Propbank/Propbank-orig/data/' || if(k = 0, 'spoken', genre) || '/' || d || '.prop') AS path, if(k = 0, 1, 0) AS alternates, num % 23 = 0 AND k <> 0 AS ambiguous FROM doc WHERE k <> 10),
scan AS (SELECT d AS document_id, CASE WHEN k = 9 THEN 'ambiguous_ptb_path' WHEN num % 29 = 0 THEN 'unclosed_parenthesis' END AS tree_error, n FROM doc WHERE num % 19 <> 0),
fields AS (SELECT document_id, line_no, row, string_split(row, ' ') AS f FROM line JOIN chosen ON d = document_id WHERE NOT ambiguous),
rec AS (SELECT *, try_cast(f[1] AS INT) AS sentence_index, try_cast(f[2] AS INT) AS predicate_index, if(f[6] = '-----', right(f[4], 1), 'classic') AS kind, len(list_filter(f, lambda x: ends_with(x, '-rel'))) AS n_rel FROM fields),
rec2 AS (SELECT *, if(sentence_index IS NULL OR predicate_index IS NULL, 'record_fixed_fields_invalid', NULL) AS row_error,
    CASE WHEN sentence_index IS NOT NULL AND row_number() OVER w > 1 THEN if(first_value(row) OVER w = row, 'exact', 'conflicting') END AS duplicate FROM rec WINDOW w AS (PARTITION BY document_id, sentence_index, predicate_index ORDER BY line_no)),
full_ AS (SELECT rec2.*, CASE WHEN row_error IS NOT NULL THEN row_error WHEN coalesce(text_files, 0) = 0 AND (n IS NULL OR tree_error IS NOT NULL) THEN 'text_and_ptb_document_missing_or_invalid' WHEN coalesce(text_files, 0) = 0 THEN 'text_document_missing'
    WHEN n IS NULL OR tree_error IS NOT NULL THEN 'ptb_document_missing_or_invalid' WHEN sentence_index >= n THEN 'sentence_index_out_of_range' WHEN predicate_index >= 6 THEN 'predicate_terminal_out_of_range' END AS reason
  FROM rec2 LEFT JOIN presence USING (document_id) LEFT JOIN scan USING (document_id)),
asked AS (SELECT d AS document_id FROM doc WHERE num % 10 <> 9), admitted AS (SELECT * FROM asked WHERE NOT starts_with(document_id, 'wsj_')),
early AS (SELECT document_id, layer || '_layer_missing' AS reason FROM admitted, (VALUES ('text'), ('ptb'), ('prop')) l(layer) WHERE NOT EXISTS (FROM f WHERE f.document_id = admitted.document_id AND f.layer = l.layer)
  UNION ALL SELECT document_id, 'cross_layer_genre_conflict' FROM admitted JOIN presence USING (document_id) WHERE conflict),
eligible AS (SELECT document_id, CASE WHEN ambiguous THEN 'prop_path_ambiguous' WHEN ptb_files <> 1 OR text_files <> 1 THEN 'layer_path_ambiguous' END AS ambiguous FROM admitted JOIN presence USING (document_id) JOIN chosen USING (document_id) WHERE document_id NOT IN (SELECT document_id FROM early)),
valid AS (SELECT rec2.*, CASE WHEN row_error IS NOT NULL THEN row_error WHEN sentence_index >= n THEN 'sentence_index_out_of_range' WHEN predicate_index >= 6 THEN 'predicate_terminal_out_of_range' END AS reason
  FROM rec2 JOIN eligible USING (document_id) JOIN scan USING (document_id) WHERE eligible.ambiguous IS NULL AND tree_error IS NULL),
reason AS (FROM early UNION ALL SELECT document_id, ambiguous FROM eligible WHERE ambiguous IS NOT NULL UNION ALL SELECT document_id, 'ptb_tree_syntax_invalid' FROM eligible JOIN scan USING (document_id) WHERE tree_error IS NOT NULL AND ambiguous IS NULL
  UNION ALL SELECT document_id, reason FROM valid WHERE reason IS NOT NULL UNION ALL SELECT document_id, duplicate || '_duplicate_predicate' FROM valid WHERE reason IS NULL AND duplicate IS NOT NULL
  UNION ALL SELECT document_id, 'wsj_denied_override' FROM asked WHERE starts_with(document_id, 'wsj_')),
retained AS (SELECT * FROM valid WHERE document_id NOT IN (SELECT document_id FROM reason)),
conv AS (SELECT *, document_id || ' ' || row AS raw_line, CASE WHEN kind = 'classic' THEN 'predicate_pos_mismatch' WHEN contains(row, ' 2:1-ARG1') THEN 'argument_has_no_surface_realization' END AS reason_code FROM retained WHERE kind IN ('v', 'classic'))"""


def oracle_sql() -> dict[str, str]:
    return {
        "archive_members": f"{FILES} SELECT archive || '.zip' AS archive, path, ends_with(path, '/') AS is_dir, clean, layer, genre, document_id, unsafe, symlink, encrypted, damaged FROM m3",
        "archive_decoding": f"""{FILES} SELECT d AS document_id, CASE num % 4 WHEN 2 THEN 'utf-16' WHEN 3 THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding, d || ' café ' || repeat('x', (1 + length(d) % 2)::INT) AS text FROM doc WHERE k <> 3""",
        "archive_safety": f"""{FILES} SELECT count(*)::BIGINT AS entries, count(*) FILTER (WHERE NOT ends_with(path, '/'))::BIGINT AS files, count(*) FILTER (WHERE clean)::BIGINT AS clean_files, count(*) FILTER (WHERE unsafe)::BIGINT AS unsafe,
  count(*) FILTER (WHERE symlink)::BIGINT AS symlinks, count(*) FILTER (WHERE encrypted)::BIGINT AS encrypted, count(*) FILTER (WHERE damaged)::BIGINT AS damaged, (count(*) - count(DISTINCT path))::BIGINT AS duplicate_names,
  (count(*) - count(DISTINCT lower(path)))::BIGINT AS casefold_collisions, bool_or(path = 'Propbank/README.txt') AS readme_present FROM m3""",
        "archive_problems": f"""{FILES} SELECT 'unsafe' AS problem, path FROM m3 WHERE unsafe UNION ALL SELECT 'symlink', path FROM m3 WHERE symlink UNION ALL SELECT 'encrypted', path FROM m3 WHERE encrypted
UNION ALL SELECT 'damaged', path FROM m3 WHERE damaged UNION ALL SELECT 'invalid_genre', path FROM m3 WHERE layer IS NOT NULL AND genre IS NULL""",
        "archive_notices": f"""{FILES} SELECT if(contains(path, '/framefiles/'), 'frame', 'archive') AS notice, path FROM m3
WHERE clean AND CASE WHEN contains(path, '/framefiles/') THEN regexp_full_match(lower(name), '(copying|license|notice)-[anv](\\.[^.]*)?') ELSE regexp_full_match(lower(name), '(copying|license|notice)(\\.[^.]*)?') END""",
        "archive_suffixes": f"{FILES} SELECT coalesce(nullif(lower(regexp_extract(name, '.(\\.[^.]+)$', 1)), ''), '<none>') AS suffix, count(*)::BIGINT AS files FROM m3 WHERE clean GROUP BY 1",
        "archive_duplicate_names": f"{FILES} SELECT layer, document_id, string_agg(name, ' ' ORDER BY name) AS names FROM f GROUP BY ALL HAVING count(*) > 1",
        "archive_layer_summary": f"""{FILES} SELECT layer, count(*)::BIGINT AS files, count(DISTINCT document_id)::BIGINT AS canonical_documents, count(*) FILTER (WHERE genre = 'spoken')::BIGINT AS spoken_files,
  count(*) FILTER (WHERE genre = 'written')::BIGINT AS written_files, count(*) FILTER (WHERE starts_with(document_id, 'wsj_'))::BIGINT AS wsj_files FROM f GROUP BY layer""",
        "archive_missing_layers": f"{FILES} SELECT layer, document_id FROM (VALUES ('text'), ('ptb'), ('prop')) l(layer), presence EXCEPT SELECT layer, document_id FROM f",
        "archive_record_files": f"{ROWS} SELECT document_id, path, alternates::BIGINT AS alternates, ambiguous FROM chosen",
        "archive_tree_scan": f"{ROWS} SELECT document_id, if(tree_error IS NULL, n, NULL)::INT AS sentences, if(tree_error IS NULL, rtrim(repeat('6 ', n::INT)), NULL) AS terminals, tree_error FROM scan",
        "archive_join_rows": f"{ROWS} SELECT document_id, line_no, row, sentence_index, predicate_index, kind, n_rel::INT AS n_rel, row_error, reason, duplicate FROM full_",
        "archive_exclusions": f"""{ROWS} SELECT document_id, string_agg(DISTINCT reason, ' ' ORDER BY reason) AS reasons, coalesce(any_value(c.n), 0)::BIGINT AS n FROM reason LEFT JOIN (SELECT document_id, count(*) AS n FROM full_ GROUP BY ALL) c USING (document_id) GROUP BY document_id""",
        "archive_retained": f"{ROWS} SELECT document_id, line_no, row FROM retained",
        "archive_conversion": f"{ROWS} SELECT raw_line, reason_code, CASE WHEN reason_code IS NULL THEN 'B-ARG0 B-V B-ARG1 I-ARG1 O' END AS tags FROM conv",
        "archive_findings": f"""{ROWS}, x AS (SELECT *, contains(row, ' 2:1-ARG1') AS bare FROM conv) SELECT count(*)::BIGINT AS records_examined, count(*) FILTER (WHERE bare)::BIGINT AS no_surface_arguments, 0::BIGINT AS linked_no_surface_arguments,
  count(*) FILTER (WHERE bare)::BIGINT AS unlinked_no_surface_arguments, count(*) FILTER (WHERE bare)::BIGINT AS records_with_no_surface, count(*) FILTER (WHERE bare)::BIGINT AS records_with_unlinked_no_surface,
  count(*) FILTER (WHERE bare)::BIGINT AS records_with_unlinked_unindexed_pro FROM x""",
        "archive_inventory": f"""{ROWS}, i AS (SELECT if(kind = 'classic', 'dialect_classic', 'dialect_modern') AS item FROM retained UNION ALL SELECT 'predicate_type_' || kind FROM retained WHERE kind <> 'classic'
  UNION ALL SELECT if(contains(row, '*'), 'records_star', 'records_simple') FROM retained UNION ALL SELECT 'pointer_fields_star' FROM retained WHERE contains(row, '*')) SELECT item, count(*)::BIGINT AS n FROM i GROUP BY item""",
        "archive_rights": f"""{ROWS} SELECT CASE WHEN starts_with(document_id, 'wsj_') THEN 'Wall Street Journal' WHEN num % 5 = 0 OR num IS NULL THEN 'Unmapped' ELSE string_split(document_id, '-')[1] END AS family,
  CASE WHEN starts_with(document_id, 'wsj_') THEN 'deny' WHEN document_id IN (SELECT document_id FROM admitted) THEN 'diagnostic' ELSE 'hold' END AS disposition, count(*)::BIGINT AS documents FROM presence LEFT JOIN doc ON d = document_id GROUP BY ALL""",
        "archive_gates": f"""{ROWS} SELECT true AS acquisition_pin, NOT bool_or(unsafe OR symlink OR encrypted OR damaged) AND count(*) = count(DISTINCT lower(path)) AS archive_safety, false AS g1_rights,
  (SELECT count(*) FROM retained) > 0 AND (SELECT count(*) FROM reason) = 0 AS g2_join, (SELECT coalesce(avg((reason_code IS NULL)::INT), 0) FROM conv) >= 0.99 AS g3_annotation_fit, 'archive_safety_check_failed' AS decision FROM m3""",
    }
