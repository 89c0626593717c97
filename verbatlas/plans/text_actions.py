"""Queries of text splitting, predicate candidates and action frames, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.functions import lexicon as lx
from verbatlas.operators import actions, text
from verbatlas.session import read, spread
from verbatlas.sources import sinks

#: Verbs of the test documents beyond the base vocabulary.
OPTIONS = actions.ExtractionOptions(additional_verbs=("Track ", "note", "grade", "bill", "seal", "trace"))
STRICT = actions.ExtractionOptions(min_confidence=0.7)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sentences(documents(spark, sf_dir))


def tokens_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tokens(documents(spark, sf_dir))


def token_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.tokens(documents(spark, sf_dir))
    return found.groupBy((F.col("end") - F.col("start")).alias("length")).agg(F.count("*").alias("tokens"), F.min("lower").alias("first_token"))


def predicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.predicate_candidates(documents(spark, sf_dir), OPTIONS).select(
        "doc_id", "sentence_index", "cand", "predicate_index", "predicate", "lemma", "start", "end", F.size("words").alias("n_words"),
        F.array_join(F.transform("words", lambda w: F.concat_ws("@", w["text"], w["start"].cast("string"), w["end"].cast("string"))), " ").alias("words"),
    )


def candidate_counts_by_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = actions.predicate_candidates(documents(spark, sf_dir), OPTIONS)
    return found.groupBy("lemma").agg(F.count("*").alias("candidates"), F.count_distinct("doc_id").alias("docs"))


def action_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.flat_frames(actions.action_frames(documents(spark, sf_dir), OPTIONS))


def confident_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.flat_frames(actions.action_frames(documents(spark, sf_dir), STRICT))


def qualifiers_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.qualifiers_long(actions.action_frames(documents(spark, sf_dir), OPTIONS))


def extraction_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = actions.extraction_results(documents(spark, sf_dir), OPTIONS)
    return found.select("doc_id", F.posexplode("warnings").alias("warning_no", "warning"))


def action_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.result_json(actions.extraction_results(documents(spark, sf_dir), OPTIONS))


def queries() -> dict:
    return {f.__name__: f for f in (
        sentences, tokens_with_offsets, token_length_stats, predicate_candidates, candidate_counts_by_lemma,
        action_frames, confident_frames, qualifiers_long, extraction_warnings, action_json,
    )}


SIGN = r"[^\p{L}\p{N}\p{Z}_\t\n\x0B\f\r\x1c-\x1f\x{85}]"
WORD = r"[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


SENTENCES = r"""
SELECT doc_id, sentence_index::INT AS sentence_index, sentence, first::INT AS start, (first + length(sentence))::INT AS "end" FROM (
  SELECT *, lead + coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM (SELECT doc_id, lead, unnest(l) AS sentence, unnest(range(len(l))) AS sentence_index FROM (
    SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS l, length(regexp_extract(text, '^[.!?]*')) AS lead FROM documents WHERE text IS NOT NULL)))"""

TOKENS = f"""
SELECT doc_id, sentence_index, (row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY n) - 1)::INT AS tok, tile AS token,
       lower(tile) AS lower, place::INT AS start, (place + length(tile))::INT AS "end" FROM (
  SELECT *, first + coalesce(sum(length(tile)) OVER (PARTITION BY doc_id, sentence_index ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM (SELECT doc_id, sentence_index, start AS first, unnest(t) AS tile, unnest(range(len(t))) AS n FROM (
    SELECT *, regexp_extract_all(sentence, '(?s){WORD}|{SIGN}|.') AS t FROM ({SENTENCES}))))
WHERE regexp_matches(tile, '^(?:[A-Za-z0-9]|{SIGN})')"""


def lemmas_sql(options: actions.ExtractionOptions) -> str:
    """The lemma of every word of the texts, by the suffix rules in SQL over the base verbs and the additional ones."""
    verbs = ", ".join([*(f"'{v}'" for v in lx.BASE_VERBS), *(f"lower(trim('{v}'))" for v in options.additional_verbs)])
    irregular = ", ".join(f"('{form}', '{lemma}')" for form, lemma in lx.IRREGULAR.items())
    return f"""
irregular(form, lemma) AS (VALUES {irregular}),
word AS (SELECT DISTINCT lower AS form, [{verbs}] AS verbs FROM tok),
stem AS (SELECT *, CASE WHEN ends_with(form, 'ing') AND length(form) >= 5 THEN form[:-4] END AS ing, CASE WHEN ends_with(form, 'ed') AND length(form) >= 4 THEN form[:-3] END AS ed FROM word),
guess AS (SELECT *, [CASE WHEN ends_with(form, 'ied') AND length(form) >= 4 THEN form[:-4] || 'y' END,
    ing, ing || 'e', CASE WHEN length(ing) > 2 AND ing[-1] = ing[-2] THEN ing[:-2] END, ed || 'e', ed, CASE WHEN length(ed) > 2 AND ed[-1] = ed[-2] THEN ed[:-2] END,
    CASE WHEN ends_with(form, 'es') AND length(form) >= 4 THEN form[:-3] END, CASE WHEN ends_with(form, 'es') AND length(form) >= 4 THEN form[:-2] END, CASE WHEN ends_with(form, 's') AND length(form) >= 3 THEN form[:-2] END] AS guesses FROM stem),
lex AS (SELECT form, CASE WHEN irregular.lemma IS NOT NULL THEN if(list_contains(verbs, irregular.lemma), irregular.lemma, NULL) WHEN list_contains(verbs, form) THEN form
    ELSE list_filter(guesses, lambda g: list_contains(verbs, g))[1] END AS lemma FROM guess LEFT JOIN irregular USING (form))"""


def candidates_sql(options: actions.ExtractionOptions) -> str:
    return f"""
WITH tok AS MATERIALIZED ({TOKENS}),{lemmas_sql(options)},
marked AS (SELECT tok.*, CASE WHEN lower NOT IN ({quoted(lx.AUXILIARIES)})
    AND coalesce(lag(lower) OVER (PARTITION BY doc_id, sentence_index ORDER BY tok) NOT IN ({quoted(lx.DETERMINERS)}), true) THEN lex.lemma END AS lemma
  FROM tok LEFT JOIN lex ON form = lower),
cand AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY tok) - 1)::INT AS cand FROM marked WHERE lemma IS NOT NULL)"""


def frames_sql(options: actions.ExtractionOptions) -> str:
    lead, trail = "(,:;CT", "),:;.CT"
    return f"""{candidates_sql(options)},
kind AS (SELECT doc_id, sentence_index,
    string_agg(CASE WHEN lower = 'then' THEN 'T' WHEN lower IN ({quoted(lx.COORDINATORS)}) THEN 'C' WHEN lower IN ({quoted(lx.DISCOURSE)}) THEN 'D'
      WHEN lower IN ({quoted(lx.AUXILIARIES)}) THEN 'X' WHEN lower IN ({quoted(lx.PREPOSITIONS)}) THEN 'P' WHEN token IN (',', ':', ';') THEN token
      WHEN token IN ('.', '!', '?') THEN '.' WHEN token IN (')', ']', '}}') THEN ')' WHEN token IN ('(', '[', '{{') THEN '(' ELSE 'w' END, '' ORDER BY tok) AS kinds,
    list(lower ORDER BY tok) AS lowers, list(start ORDER BY tok) AS starts, list("end" ORDER BY tok) AS ends, max(tok) FILTER (WHERE lemma IS NOT NULL) AS last
  FROM marked GROUP BY doc_id, sentence_index HAVING count(lemma) > 0),
a0 AS (SELECT cand.*, kinds, lowers, starts, ends, last, regexp_extract(kinds[1:tok], '[^CT,:;.]*$') AS clause FROM cand JOIN kind USING (doc_id, sentence_index)),
a1 AS (SELECT *, rtrim(rtrim(ltrim(clause, '{lead}'), '{trail}'), 'X') AS inner_, tok - length(ltrim(ltrim(ltrim(clause, '{lead}'), 'DT'), '{lead}')) AS a_first FROM a0),
a2 AS (SELECT *, length(rtrim(ltrim(ltrim(inner_, 'DT'), '{lead}'), '{trail}')) AS a_len FROM a1),
a3 AS (SELECT *, last_value(CASE WHEN a_len > 0 THEN {{'f': a_first, 'l': a_first + a_len - 1}} END IGNORE NULLS)
    OVER (PARTITION BY doc_id, sentence_index ORDER BY tok ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS actor,
    kinds[tok + 2 : last] AS near FROM a2),
t0 AS (SELECT *, CASE WHEN regexp_matches(near, '[;.CT]') THEN regexp_extract(near, '^[^;.CT]*')
    ELSE near || regexp_extract(kinds[tok + 2 + length(near) :], '^[^;.]*') END AS whole FROM a3),
t1 AS (SELECT *, rtrim(ltrim(whole, '{lead}'), '{trail}') AS tail, tok + 1 + length(whole) - length(ltrim(whole, '{lead}')) AS tail_at FROM t0),
p0 AS (SELECT *, regexp_extract(tail, '^[^P]*') AS p_all FROM t1),
p1 AS (SELECT *, tail_at + length(p_all) - length(ltrim(p_all, '{lead}')) AS p_first, length(rtrim(ltrim(p_all, '{lead}'), '{trail}')) AS p_len FROM p0),
q0 AS (SELECT doc_id, sentence_index, cand, tail, tail_at, lowers, starts, ends, unnest(range(length(tail))) AS i FROM p1),
q1 AS (SELECT *, regexp_extract(tail[i + 2 :], '^[^PCT,:;.]*') AS value FROM q0 WHERE tail[i + 1] = 'P'),
q2 AS (SELECT *, tail_at + i + 1 + length(value) - length(ltrim(value, '{lead}')) AS q_first, length(rtrim(ltrim(value, '{lead}'), '{trail}')) AS q_len FROM q1),
qual AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, sentence_index, cand ORDER BY i) - 1)::INT AS qualifier FROM q2 WHERE q_len > 0),
frame AS (SELECT p1.*, coalesce(n, 0)::INT AS n_qualifiers, 0.4::DOUBLE + CASE WHEN actor IS NULL THEN 0 ELSE 0.15 END + CASE WHEN p_len > 0 THEN 0.15 ELSE 0 END
    + CASE WHEN n > 0 THEN 0.05 ELSE 0 END + 0.1 AS confidence
  FROM p1 LEFT JOIN (SELECT doc_id, sentence_index, cand, count(*) AS n FROM qual GROUP BY ALL) USING (doc_id, sentence_index, cand)),
located AS (SELECT f.doc_id, f.sentence_index, f.cand, starts[actor.f + 1] AS actor_start, ends[actor.l + 1] AS actor_end, token AS predicate_text,
    f.start AS predicate_start, f."end" AS predicate_end, lemma, CASE WHEN p_len > 0 THEN starts[p_first + 1] END AS patient_start,
    CASE WHEN p_len > 0 THEN ends[p_first + p_len] END AS patient_end, n_qualifiers, round(confidence, 3) AS confidence, 'rule-based-v0' AS extractor, d.text
  FROM frame f JOIN documents d USING (doc_id) WHERE confidence >= {options.min_confidence}),
flat AS (SELECT * EXCLUDE (text) REPLACE (coalesce(actor_start, -1) AS actor_start, coalesce(actor_end, -1) AS actor_end,
    coalesce(patient_start, -1) AS patient_start, coalesce(patient_end, -1) AS patient_end),
    text[actor_start + 1 : actor_end] AS actor_text, text[patient_start + 1 : patient_end] AS patient_text FROM located)"""


def warnings_sql(options: actions.ExtractionOptions) -> str:
    return f"""{frames_sql(options)},
w AS (SELECT DISTINCT doc_id, sentence_index, 'Sentence ' || sentence_index || ' contains possible negation; rule-based-v0 does not encode action polarity.' AS warning
  FROM flat SEMI JOIN (SELECT doc_id, sentence_index FROM tok WHERE lower IN ({quoted(lx.NEGATIONS)})) n USING (doc_id, sentence_index)
  UNION ALL
  SELECT doc_id, 0, '{actions.NO_MATCH}' FROM documents d ANTI JOIN flat USING (doc_id)
  WHERE regexp_matches(text, '[^\\p{{Z}}\\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x{{85}}]'))"""


NUMBERED_WARNINGS = "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index) - 1)::INT AS warning_no, warning FROM w"


def oracle_sql() -> dict[str, str]:
    return {
        "sentences": SENTENCES,
        "tokens_with_offsets": TOKENS,
        "token_length_stats": f'SELECT ("end" - start)::INT AS length, count(*)::BIGINT AS tokens, min(lower) AS first_token FROM ({TOKENS}) GROUP BY 1',
        "predicate_candidates": f"""{candidates_sql(OPTIONS)}
SELECT doc_id, sentence_index, cand, tok AS predicate_index, token AS predicate, lemma, start, "end", n_words, words
FROM cand JOIN (SELECT doc_id, sentence_index, count(*)::INT AS n_words, string_agg(token || '@' || start || '@' || "end", ' ' ORDER BY tok) AS words FROM tok GROUP BY ALL) USING (doc_id, sentence_index)""",
        "candidate_counts_by_lemma": f"""{candidates_sql(OPTIONS)}
SELECT lemma, count(*)::BIGINT AS candidates, count(DISTINCT doc_id)::BIGINT AS docs FROM cand GROUP BY lemma""",
        "action_frames": f"{frames_sql(OPTIONS)} SELECT * FROM flat",
        "confident_frames": f"{frames_sql(STRICT)} SELECT * FROM flat",
        "qualifiers_long": f"""{frames_sql(OPTIONS)}
SELECT doc_id, sentence_index, cand, qualifier, lowers[tail_at + i + 1] AS relation, text[starts[q_first + 1] + 1 : ends[q_first + q_len]] AS value,
  starts[q_first + 1] AS start, ends[q_first + q_len] AS "end" FROM qual JOIN documents USING (doc_id)""",
        "extraction_warnings": f"{warnings_sql(OPTIONS)} {NUMBERED_WARNINGS}",
        "action_json": f"""{warnings_sql(OPTIONS)},
ql AS (SELECT doc_id, sentence_index, cand, list({{'relation': lowers[tail_at + i + 1], 'value': {{'text': text[starts[q_first + 1] + 1 : ends[q_first + q_len]], 'start': starts[q_first + 1], 'end': ends[q_first + q_len]}}}} ORDER BY qualifier) AS qualifiers
  FROM qual JOIN documents USING (doc_id) GROUP BY ALL),
ac AS (SELECT doc_id, list({{'actor': CASE WHEN actor_start >= 0 THEN {{'text': actor_text, 'start': actor_start, 'end': actor_end}} END, 'predicate': {{'text': predicate_text, 'start': predicate_start, 'end': predicate_end}}, 'predicate_lemma': lemma,
    'patient': CASE WHEN patient_start >= 0 THEN {{'text': patient_text, 'start': patient_start, 'end': patient_end}} END, 'qualifiers': coalesce(qualifiers, []), 'sentence_index': sentence_index, 'confidence': confidence, 'extractor': extractor}} ORDER BY sentence_index, cand) AS actions
  FROM flat LEFT JOIN ql USING (doc_id, sentence_index, cand) GROUP BY doc_id),
wl AS (SELECT doc_id, list(warning ORDER BY sentence_index) AS warnings FROM w GROUP BY doc_id)
SELECT doc_id, to_json({{'text': text, 'actions': coalesce(actions, []), 'warnings': coalesce(warnings, [])}})::VARCHAR AS json FROM documents LEFT JOIN ac USING (doc_id) LEFT JOIN wl USING (doc_id)""",
    }
