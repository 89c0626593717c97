"""Queries of sources, sinks, streams and error cases, and their SQL twins.

Streams read the tables as arriving files, once, and write to the shared folder; files are written there and read back.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.operators import actions, align, trees
from verbatlas.plans import text_actions, training_data
from verbatlas.plans.trees_and_records import LABEL_IDS, fixed_pieces
from verbatlas.session import read, remove_at_exit, shared_dir
from verbatlas.sources import sinks, texts
from verbatlas.streaming import actions as streams


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver exits."""
    path = f"{shared_dir(spark)}/verbatlas/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The files of a table as a stream."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path if os.path.isdir(path) else f"{sf_dir}/{table}.parquet*")


def drained(stream: DataFrame, name: str, complete: bool = False) -> DataFrame:
    """What a stream has given when all files are read, by way of Parquet files."""
    spark = stream.sparkSession
    out = folder(spark, name)
    writer = stream.writeStream.option("checkpointLocation", folder(spark, f"{name}-state")).trigger(availableNow=True)
    if complete:  # the last batch holds all groups
        query = writer.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def streamed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action frames of documents that arrive."""
    documents = table_stream(spark, sf_dir, "documents").select("doc_id", "text")
    return drained(actions.flat_frames(streams.frame_stream(documents, text_actions.OPTIONS)), "frames")


def streamed_lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per lemma and day of documents that arrive."""
    documents = table_stream(spark, sf_dir, "documents").select("doc_id", "text", "ingested_at")
    found = drained(streams.lemma_counts(documents, "ingested_at", options=text_actions.OPTIONS), "lemmas", complete=True)
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "lemma", "candidates")


def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records and rejects of record text that arrives."""
    found = drained(streams.record_stream(table_stream(spark, sf_dir, "raw_records").select("line_id", "line")), "records")
    return found.select("line_id", "example_id", "predicate_index", F.array_join("words", " ").alias("words"), "reason")


def texts_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one UTF-8 file for each roleset of the catalogue, with options of a TOML file."""
    text = F.concat_ws(" ", F.lit("Zoë will"), "lemma", F.lit("the crate 🎉 in Łódź.\nPlease call")).alias("value")
    path = folder(spark, "texts")
    read(spark, sf_dir, "roleset_catalog").select("predicate_roleset", text).write.partitionBy("predicate_roleset").text(path)
    config = folder(spark, "options")
    toml = '[baseline]\nadditional_verbs = [" Forward ", "list", "measure", "carry"]\nmin_confidence = 0.5\n'
    spark.createDataFrame([(toml,)], "value string").write.text(config)
    options = texts.read_options(spark, config)
    found = actions.flat_frames(actions.action_frames(texts.from_files(spark, f"{path}/*/*.txt"), options, "file"), "file")
    roleset = F.regexp_extract("file", "predicate_roleset=([^/]+)/", 1)
    return found.select(roleset.alias("predicate_roleset"), "sentence_index", "cand", "actor_text", "lemma", "patient_text", "predicate_start", "confidence")


def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON lines and read back."""
    results = actions.extraction_results(text_actions.documents(spark, sf_dir), text_actions.OPTIONS)
    path = folder(spark, "results")
    sinks.write_results(results, path)
    back = spark.read.schema(results.schema).json(path)
    lemmas = F.array_join(F.transform("actions", lambda a: a["predicate_lemma"]), " ")
    nulls = spark.read.text(path).where(F.col("value").contains('"actor":null') | F.col("value").contains('"patient":null'))
    return back.select("doc_id", "text", F.size("actions").alias("n_actions"), lemmas.alias("lemmas"), F.size("warnings").alias("n_warnings")).withColumn("null_members_kept", nulls.agg(F.count("*") > 0).scalar())


def pretty_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented JSON holds what plain JSON does: both parsed and written anew."""
    results = actions.extraction_results(text_actions.documents(spark, sf_dir), text_actions.OPTIONS)
    schema = results.select(F.struct("text", "actions", "warnings").alias("x")).schema["x"].dataType
    pretty = sinks.result_json(results, pretty=True)
    return pretty.select("doc_id", F.col("json").contains("\n").alias("indented"), F.to_json(F.from_json("json", schema), sinks.KEEP_NULLS).alias("json"))


def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collator gets for every example that aligns."""
    rows = read(spark, sf_dir, "srl_examples").select("example_id", "words", "tags", "predicate_index").dropDuplicates(["example_id"])
    found = align.model_inputs(align.align_labels(align.tokenize_words(rows, fixed_pieces), LABEL_IDS), "example_id")
    numbers = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return found.select("example_id", numbers("input_ids"), numbers("attention_mask"), numbers("token_type_ids"), numbers("labels"))


#: Texts of trees, good and bad, around a word, with the code that each must give.
TREE_CASES = (
    ("(A (B {w}))", ""), ("( (A (B {w}) (C d)) )", ""), ("", "tree_source_empty"), ("(A (B {w})) x", "tree_syntax_invalid"), ("(A (B {w})", "tree_syntax_invalid"), ("(A ((B {w})))", "nested_unlabeled_wrapper_invalid"),
    ("((A {w}) (C d))", "unlabeled_tree_wrapper_invalid"), ("(A {w} (C d))", "tree_structure_invalid"), ("(A {w} c)", "tree_structure_invalid"), ("(A)", "tree_structure_invalid"), ("()", "tree_syntax_invalid"),
    ("(A {w}) (C d)", "tree_count_invalid"), ("(A (B {w})))", "tree_syntax_invalid"), ("{w}", "tree_syntax_invalid"), ("(A (B {w}) ())", "tree_syntax_invalid"),
)


def tree_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.element_at(F.array(*(F.lit(t) for t, _ in TREE_CASES)), (F.col("event_id") % len(TREE_CASES)).cast("int") + 1)
    return read(spark, sf_dir, "events").select("event_id", F.replace(case, F.lit("{w}"), F.concat(F.lit("w"), (F.col("user_id") % 7).cast("string"))).alias("source"))


def tree_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree texts made from events: the error, or the number of nodes and the words."""
    found = trees.parse_trees(tree_texts(spark, sf_dir), "source", "event_id", single=True)
    return found.select("event_id", "tree_error", F.size("nodes").alias("n_nodes"), F.array_join(trees.surface_words(F.col("terminals")), " ").alias("words"))


def balanced_tree_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts by brackets alone."""
    found = trees.balanced_counts(tree_texts(spark, sf_dir), "source", "event_id")
    return found.select("event_id", "sentences", F.array_join(F.transform("terminals", lambda n: n.cast("string")), " ").alias("terminals"), "tree_error")


def queries() -> dict:
    return {f.__name__: f for f in (
        streamed_frames, streamed_lemma_counts, streamed_records, texts_of_files, written_results, pretty_results, model_inputs, tree_errors, balanced_tree_errors,
    )}


TREE_TEXTS = f"""
WITH s AS (SELECT event_id, event_id % {len(TREE_CASES)} AS k, replace([{", ".join(f"'{t}'" for t, _ in TREE_CASES)}][event_id % {len(TREE_CASES)} + 1], '{{w}}', 'w' || (user_id % 7)) AS source,
    nullif([{", ".join(f"'{c}'" for _, c in TREE_CASES)}][event_id % {len(TREE_CASES)} + 1], '') AS expected FROM events)"""


def oracle_sql() -> dict[str, str]:
    options, plain = text_actions.OPTIONS, text_actions.oracle_sql()
    file_options = actions.ExtractionOptions(additional_verbs=("forward", "list", "measure", "carry"), min_confidence=0.5)
    files = "(SELECT predicate_roleset AS doc_id, 'Zoë will ' || lemma || ' the crate 🎉 in Łódź.' || chr(10) || 'Please call' AS text FROM roleset_catalog)"
    frames = text_actions.frames_sql(file_options).replace("FROM documents", f"FROM {files}").replace("JOIN documents d", f"JOIN {files} d").replace("JOIN documents", f"JOIN {files}")
    return {
        "streamed_frames": plain["action_frames"],
        "streamed_lemma_counts": f"""{text_actions.candidates_sql(options)}
SELECT strftime(ingested_at, '%Y-%m-%d') AS day, lemma, count(*)::BIGINT AS candidates FROM cand JOIN documents USING (doc_id) WHERE ingested_at IS NOT NULL GROUP BY ALL""",
        "streamed_records": f"""{training_data.P5_PARSED}
SELECT line_id, if(reason IS NULL, v[1], NULL) AS example_id, if(reason IS NULL, v[5]::INT, NULL) AS predicate_index, if(reason IS NULL, v[4], NULL) AS words, reason FROM j""",
        "texts_of_files": f"{frames} SELECT doc_id AS predicate_roleset, sentence_index, cand, actor_text, lemma, patient_text, predicate_start, confidence FROM flat",
        "written_results": f"""{text_actions.warnings_sql(options)}
SELECT doc_id, text, coalesce(n, 0)::INT AS n_actions, coalesce(lemmas, '') AS lemmas, coalesce(nw, 0)::INT AS n_warnings, true AS null_members_kept FROM documents
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(lemma, ' ' ORDER BY sentence_index, cand) AS lemmas FROM flat GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS nw FROM w GROUP BY doc_id) USING (doc_id)""",
        "pretty_results": f"SELECT doc_id, true AS indented, json FROM ({plain['action_json']})",
        "model_inputs": f"""
WITH ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id) AS rn FROM (SELECT DISTINCT example_id, words, tags, predicate_index FROM srl_examples)) WHERE rn = 1),
ids(label, id) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in LABEL_IDS.items())}),
w AS (SELECT example_id, coalesce(unnest(words), '') AS word, unnest(tags) AS tag, unnest(range(len(words))) AS pos, predicate_index FROM ex),
piece AS (SELECT w.*, k, if(k = 0 OR tag = 'O', tag, 'I-' || tag[3:]) AS label, word[k * 4 + 1 : k * 4 + 4] AS text FROM w, unnest(range(greatest(1, ceil(length(word) / 4))::BIGINT)) r(k)),
c AS (SELECT example_id, bool_or(id IS NULL OR NOT regexp_full_match(tag, '(?s)O|[BI]-.+')) AS bad, count(*) AS n, string_agg(id, ' ' ORDER BY pos, k) AS labels, string_agg((k = 0 AND pos = predicate_index)::INT, ' ' ORDER BY pos, k) AS kinds,
  string_agg(1000 + coalesce(list_sum(list_transform(string_split(text, ''), lambda x: if(x = '', 0, ord(x)))), 0)::BIGINT % 997, ' ' ORDER BY pos, k) AS numbers FROM piece LEFT JOIN ids USING (label) GROUP BY example_id)
SELECT example_id, '101 ' || numbers || ' 102' AS input_ids, rtrim(repeat('1 ', n + 2)) AS attention_mask, '0 ' || kinds || ' 0' AS token_type_ids, '-100 ' || labels || ' -100' AS labels FROM c WHERE NOT bad""",
        "tree_errors": f"""{TREE_TEXTS}
SELECT event_id, expected AS tree_error, if(expected IS NULL, len(regexp_extract_all(source, '[(][A-Z]')), NULL)::INT AS n_nodes, if(expected IS NULL, array_to_string(regexp_extract_all(source, '[a-z0-9]+'), ' '), NULL) AS words FROM s""",
        "balanced_tree_errors": f"""{TREE_TEXTS},
ch AS (SELECT event_id, unnest(string_split(source, '')) AS c, unnest(range(length(source))) AS i FROM s WHERE source <> ''),
d AS (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY i) AS depth FROM ch),
e AS (SELECT event_id, min(depth) AS low, last(depth ORDER BY i) AS rest, count(*) FILTER (WHERE depth = 0 AND c = ')') AS n FROM d GROUP BY event_id),
g AS (SELECT event_id, grp, string_agg(c, '' ORDER BY i) AS text FROM (SELECT *, sum((depth = 0 AND c = ')')::INT) OVER (PARTITION BY event_id ORDER BY i) - (depth = 0 AND c = ')')::INT AS grp FROM d) GROUP BY ALL),
t AS (SELECT event_id, string_agg(len(regexp_extract_all(text, '\\([^()\\s]+\\s+[^()\\s]+\\)')), ' ' ORDER BY grp) FILTER (WHERE contains(text, ')')) AS terminals,
  bool_or(contains(text, ')') AND NOT regexp_matches(text, '\\([^()\\s]+\\s+[^()\\s]+\\)')) AS bare FROM g GROUP BY event_id),
x AS (SELECT s.event_id, n, terminals, CASE WHEN low < 0 THEN 'unmatched_closing_parenthesis' WHEN rest > 0 THEN 'unclosed_parenthesis' WHEN coalesce(n, 0) = 0 THEN 'no_balanced_trees' WHEN bare THEN 'tree_without_terminal' END AS tree_error
  FROM s LEFT JOIN e USING (event_id) LEFT JOIN t USING (event_id))
SELECT event_id, if(tree_error IS NULL, n, NULL)::INT AS sentences, if(tree_error IS NULL, terminals, NULL) AS terminals, tree_error FROM x""",
    }
