"""The SQL twins of trees, records and conversion: an independent reading of the same rules over unnested rows."""

from __future__ import annotations

#: All leaves as written into brackets; trees only of sentences whose leaves are numbered from 0 without gap or repetition.
LEAVES = r"""
WITH raw_leaf AS (SELECT DISTINCT document_id, sentence_index, terminal_index, word, pos, preterminal_path FROM penn_terminals),
sentence AS (SELECT document_id, sentence_index, count(*) = count(DISTINCT terminal_index) AND count(*) = count(terminal_index) AND count(*) = count(preterminal_path)
    AND min(terminal_index) = 0 AND max(terminal_index) = count(*) - 1 AS whole FROM raw_leaf GROUP BY ALL),
leaf AS (SELECT document_id, sentence_index, terminal_index, preterminal_path, w AS word, p AS pos FROM (SELECT *,
    CASE WHEN word IS NULL THEN '-NULL-' WHEN word = '' THEN '-EMPTY-' ELSE regexp_replace(replace(replace(word, '(', '-LRB-'), ')', '-RRB-'), '[\pZ\t\n\x0B\f\r\x1c-\x1f\x{85}]', '_', 'g') END AS w,
    CASE WHEN pos IS NULL THEN '-NULL-' WHEN pos = '' THEN '-EMPTY-' ELSE regexp_replace(replace(replace(pos, '(', '-LRB-'), ')', '-RRB-'), '[\pZ\t\n\x0B\f\r\x1c-\x1f\x{85}]', '_', 'g') END AS p
  FROM raw_leaf JOIN sentence USING (document_id, sentence_index) WHERE whole)),
t AS (SELECT *, CASE WHEN pos = '-NONE-' THEN -1 ELSE sum((pos <> '-NONE-')::INT) OVER (PARTITION BY document_id, sentence_index ORDER BY terminal_index) - 1 END::INT AS surface FROM leaf)"""

#: A record line of every example: the spans of its tags as pointers to the words' terminals, or to word numbers without a tree.
EXAMPLE_LINES = r""",
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id) AS rn FROM (SELECT DISTINCT example_id, document_id, words, predicate_index, tags, predicate_roleset FROM srl_examples)) WHERE rn = 1),
in_tree AS (SELECT document_id, sentence_index AS si, list(terminal_index ORDER BY terminal_index) FILTER (WHERE surface >= 0) AS places FROM t GROUP BY ALL),
ex2 AS (SELECT ex.*, places, try_cast(string_split(ex.example_id, ':')[-2] AS INT) AS si, coalesce(len(list_filter(tags, lambda x: NOT coalesce(regexp_full_match(x, '(?s)O|[BI]-.+'), false))), 0) AS n_bad
  FROM ex LEFT JOIN in_tree ON in_tree.document_id = ex.document_id AND in_tree.si = try_cast(string_split(ex.example_id, ':')[-2] AS INT)),
ex3 AS (SELECT *, CASE WHEN n_bad > 0 OR coalesce(len(tags), 0) = 0 OR len(tags) <> coalesce(len(words), 0) THEN 'example_tags_invalid'
    WHEN places IS NOT NULL AND len(places) <> len(words) THEN 'example_word_count_mismatch' END AS example_error FROM ex2),
ex4 AS (SELECT *, CASE WHEN places IS NOT NULL AND example_error IS NULL THEN places ELSE range(coalesce(len(tags), 0)) END AS places_used FROM ex3),
tag AS (SELECT example_id, tag, pos, CASE WHEN tag = 'O' THEN '' ELSE tag[3:] END AS label, place FROM
  (SELECT example_id, unnest(tags) AS tag, unnest(range(len(tags)))::INT AS pos, unnest(places_used) AS place FROM ex4 WHERE n_bad = 0)),
span_tag AS (SELECT *, sum(starts::INT) OVER (PARTITION BY example_id ORDER BY pos) AS span FROM
  (SELECT *, tag = 'O' OR tag[1] = 'B' OR lag(label, 1, '') OVER (PARTITION BY example_id ORDER BY pos) <> label AS starts FROM tag)),
span AS (SELECT example_id, span, string_agg(place || ':0', ',' ORDER BY pos) || '-' || CASE WHEN any_value(label) = 'V' THEN 'rel' ELSE any_value(label) END AS text FROM span_tag WHERE tag <> 'O' GROUP BY ALL),
spans AS (SELECT example_id, string_agg(text, ' ' ORDER BY span) AS text FROM span GROUP BY example_id),
line AS (SELECT example_id AS rid, example_error, concat_ws(' ', coalesce(document_id, '-NULL-'), coalesce(si::VARCHAR, '-NULL-'), coalesce(CASE WHEN predicate_index >= 0 THEN places_used[predicate_index + 1]::VARCHAR END, '-NULL-'),
    'gold', string_split(coalesce(predicate_roleset, '-NULL-'), '.')[1] || '-v', coalesce(predicate_roleset, '-NULL-'), '-----', text) AS raw FROM ex4 LEFT JOIN spans USING (example_id))"""

#: Fields and errors of the records in ``line(rid, example_error, raw)``.
RECORDS = r""",
field AS (SELECT rid, example_error, trim(raw) AS raw_line, CASE WHEN trim(raw) = '' THEN [] ELSE string_split_regex(trim(raw), '\s+') END AS f FROM line),
rec AS (SELECT *, len(f) AS n, coalesce(regexp_full_match(f[5], '.+-[anv]'), false) AS typed,
    CASE WHEN regexp_full_match(f[2], '\+?[0-9]+') THEN coalesce(try_cast(f[2] AS INT), 2147483647) END AS si, CASE WHEN regexp_full_match(f[3], '\+?[0-9]+') THEN coalesce(try_cast(f[3] AS INT), 2147483647) END AS pt FROM field),
rec2 AS (SELECT *, f[1] AS doc, CASE WHEN typed THEN f[6] ELSE f[5] END AS roleset, CASE WHEN typed THEN right(f[5], 1) END AS kind, CASE WHEN n < 7 THEN [] WHEN typed THEN f[8:] ELSE f[7:] END AS fields FROM rec),
lab AS (SELECT rid, typed, k, regexp_extract(text, '^([0-9]+:[0-9]+(?:[,;*][0-9]+:[0-9]+)*)-(.+)$', 1) AS raw, regexp_extract(text, '^([0-9]+:[0-9]+(?:[,;*][0-9]+:[0-9]+)*)-(.+)$', 2) AS label
  FROM (SELECT rid, typed, unnest(fields) AS text, unnest(range(len(fields))) AS k FROM rec2)),
lab2 AS (SELECT *, CASE WHEN raw = '' THEN 'proposition_label_invalid' WHEN contains(raw, ';') AND contains(raw, '*') THEN 'mixed_semicolon_chain_unsupported' WHEN contains(raw, ';') AND contains(raw, ',') THEN 'mixed_concatenation_unsupported' END AS error FROM lab),
labs AS (SELECT rid, first(error ORDER BY k) FILTER (WHERE error IS NOT NULL) AS label_error, count(*) FILTER (WHERE label = 'rel') AS rels, bool_or(contains(raw, ';')) AS has_semicolon, bool_or(regexp_matches(label, '^(LINK-|C-|R-)')) AS marked, count(*) AS n_labels FROM lab2 GROUP BY rid),
rec3 AS (SELECT rec2.*, coalesce(n_labels, 0)::INT AS n_labels, coalesce(example_error, CASE WHEN n = 0 THEN 'record_empty' WHEN n < 7 THEN 'record_field_count_invalid' WHEN si IS NULL OR pt IS NULL THEN 'record_index_invalid'
    WHEN typed AND (n < 8 OR f[7] <> '-----') THEN 'record_dialect_invalid' WHEN NOT typed AND length(f[6]) <> 5 THEN 'record_dialect_invalid' WHEN NOT contains(roleset, '.') THEN 'roleset_invalid' WHEN label_error IS NOT NULL THEN label_error
    WHEN NOT typed AND has_semicolon THEN 'classic_pointer_operator_unsupported' WHEN NOT typed AND marked THEN 'classic_label_unsupported' WHEN coalesce(rels, 0) <> 1 THEN 'predicate_label_count_invalid' END) AS record_error FROM rec2 LEFT JOIN labs USING (rid))"""

#: Pointers resolved in the trees, the reason of each record, and the tags of the converted ones.
OUTCOMES = r""",
node AS (SELECT document_id, sentence_index, level, prefix, min(terminal_index) AS lt, count(*) AS nt, coalesce(list(surface ORDER BY terminal_index) FILTER (WHERE surface >= 0), []) AS words
  FROM (SELECT document_id, sentence_index, terminal_index, surface, level, preterminal_path[1:level] AS prefix FROM t, unnest(range(len(preterminal_path) + 1)) r(level)) GROUP BY ALL),
size AS (SELECT document_id, sentence_index, whole, n FROM sentence LEFT JOIN (SELECT document_id, sentence_index, count(*) AS n FROM t GROUP BY ALL) USING (document_id, sentence_index)),
use_ AS (SELECT rec3.* FROM rec3 JOIN size ON doc = document_id AND si = sentence_index WHERE record_error IS NULL AND whole),
member AS (SELECT rid, k, unnest(string_split(raw, '*')) AS text, unnest(range(len(string_split(raw, '*')))) AS m FROM lab2 SEMI JOIN use_ USING (rid)),
pointer AS (SELECT rid, k, m, p, coalesce(try_cast(string_split(text, ':')[1] AS INT), 2147483647) AS tt, coalesce(try_cast(string_split(text, ':')[2] AS INT), 2147483647) AS h
  FROM (SELECT rid, k, m, unnest(string_split_regex(text, '[,;]')) AS text, unnest(range(len(string_split_regex(text, '[,;]')))) AS p FROM member)),
found AS (SELECT pointer.*, node.words, CASE WHEN t.terminal_index IS NULL THEN 'pointer_terminal_out_of_range' WHEN len(preterminal_path) < h THEN 'pointer_height_out_of_range' WHEN node.lt IS NULL THEN 'pointer_leftmost_terminal_mismatch' END AS error
  FROM pointer JOIN use_ USING (rid) LEFT JOIN t ON t.document_id = doc AND t.sentence_index = si AND t.terminal_index = tt
  LEFT JOIN node ON node.document_id = doc AND node.sentence_index = si AND node.level = len(preterminal_path) - h AND node.prefix = preterminal_path[1:(len(preterminal_path) - h)] AND node.lt = tt AND len(preterminal_path) >= h),
bearing AS (SELECT rid, k, count(*) AS bearing, first(pieces ORDER BY m) AS pieces FROM (SELECT rid, k, m, list(words ORDER BY p) FILTER (WHERE len(words) > 0) AS pieces FROM found GROUP BY ALL) WHERE pieces IS NOT NULL GROUP BY ALL),
failed AS (SELECT rid, k, first(error ORDER BY m, p) FILTER (WHERE error IS NOT NULL) AS error FROM found GROUP BY ALL),
item AS (SELECT lab2.rid, lab2.k, label, raw, failed.error AS code, coalesce(bearing, 0) AS bearing, coalesce(pieces, []) AS pieces, list_filter(coalesce(pieces, []), lambda x, i: list_position(pieces, x) = i) AS once,
    list_distinct(string_split_regex(raw, '[,;*]')) AS nodes, len(string_split(raw, '*')) AS members FROM lab2 SEMI JOIN use_ USING (rid) JOIN failed USING (rid, k) LEFT JOIN bearing USING (rid, k)),
item2 AS (SELECT *, flatten(once) AS flat, CASE WHEN starts_with(label, 'LINK-') THEN 'link' WHEN label = 'rel' THEN 'rel' ELSE 'arg' END AS sort FROM item),
item3 AS (SELECT *, coalesce(code, CASE WHEN bearing = 0 THEN if(sort = 'rel', 'predicate_has_no_surface', 'argument_has_no_surface_realization') WHEN bearing > 1 THEN if(sort = 'rel', 'predicate_chain_ambiguous', 'argument_trace_chain_ambiguous')
      WHEN len(flat) <> len(list_distinct(flat)) THEN 'pointer_piece_overlap' END) AS piece_code,
    regexp_full_match(label, '(C-|R-)?ARG([0-9]+|A)(-[A-Za-z0-9][A-Za-z0-9_.-]*)?') AS core, regexp_full_match(label, '(C-|R-)?ARGM-[A-Za-z0-9][A-Za-z0-9_.-]*') AS modi FROM item2),
arg AS (SELECT *, CASE WHEN core THEN regexp_extract(label, '^((?:C-|R-)?ARG(?:[0-9]+|A))', 1) WHEN modi THEN label END AS model, CASE WHEN core OR modi THEN NULL WHEN label IN ('ARGM', 'C-ARGM', 'R-ARGM') THEN 'argm_feature_missing' ELSE 'unsupported_role' END AS role_error FROM item3 WHERE sort = 'arg'),
args AS (SELECT rid, first(role_error ORDER BY k) FILTER (WHERE role_error IS NOT NULL) AS role_error, first(piece_code ORDER BY k) FILTER (WHERE piece_code IS NOT NULL) AS piece_code, list(model) AS models, flatten(list(flat)) AS covered FROM arg GROUP BY rid),
base AS (SELECT rid, first(CASE WHEN starts_with(model, 'C-') THEN 'continuation_role_without_base' ELSE 'reference_role_without_base' END ORDER BY k) AS base_code FROM arg JOIN args USING (rid)
  WHERE regexp_matches(model, '^[CR]-') AND NOT list_contains(models, model[3:]) GROUP BY rid),
late AS (SELECT DISTINCT rid FROM (SELECT a.rid, a.k FROM arg a JOIN arg b ON a.rid = b.rid AND a.model = 'C-' || b.model GROUP BY ALL HAVING min(list_min(a.flat)) <= max(list_max(b.flat)))),
link AS (SELECT rid, first(code ORDER BY k) FILTER (WHERE code IS NOT NULL) AS link_code FROM (SELECT l.rid, l.k, CASE WHEN l.label NOT IN ('LINK-PCR', 'LINK-PRO', 'LINK-PSV', 'LINK-SLC') THEN 'unsupported_link_type' WHEN l.members < 2 THEN 'link_chain_invalid'
      WHEN count(a.k) = 0 THEN 'link_argument_missing' WHEN count(a.k) > 1 THEN 'link_argument_ambiguous' ELSE any_value(l.code) END AS code
    FROM item3 l LEFT JOIN arg a ON a.rid = l.rid AND list_has_any(a.nodes, l.nodes) WHERE l.sort = 'link' GROUP BY l.rid, l.k, l.label, l.members) GROUP BY rid),
rel AS (SELECT rid, piece_code AS rel_code, pieces AS rel_pieces, flatten(pieces) AS rel_words FROM item3 WHERE sort = 'rel'),
out_ AS (SELECT rec3.rid, raw_line, concat_ws(':', doc, si::VARCHAR, pt::VARCHAR) AS record_id, doc AS document_id, si AS sentence_index, pt AS predicate_terminal, typed, coalesce(t.surface, -1) AS surface, t.pos, rel_pieces, rel_words,
    CASE WHEN NOT size.whole THEN 'tree_terminals_incomplete' WHEN record_error IS NOT NULL THEN record_error WHEN size.whole IS NULL THEN 'sentence_index_out_of_range'
      WHEN starts_with(lower(string_split(rtrim(replace(doc, '\', '/'), '/'), '/')[-1]), 'wsj_') THEN 'excluded_source_wsj'
      WHEN pt >= size.n THEN 'predicate_terminal_out_of_range' WHEN t.surface = -1 THEN 'predicate_has_no_surface' WHEN kind <> 'v' THEN 'nonverbal_type'
      WHEN t.pos NOT IN ('VB', 'VBD', 'VBG', 'VBN', 'VBP', 'VBZ') THEN 'predicate_pos_mismatch' WHEN rel_code IS NOT NULL THEN rel_code WHEN NOT list_contains(rel_words, t.surface) THEN 'rel_does_not_cover_predicate'
      WHEN link_code IS NOT NULL THEN link_code WHEN role_error IS NOT NULL THEN role_error WHEN base_code IS NOT NULL THEN base_code WHEN args.piece_code IS NOT NULL THEN args.piece_code
      WHEN late.rid IS NOT NULL THEN 'continuation_role_precedes_base' WHEN len(covered) <> len(list_distinct(covered)) THEN 'semantic_role_overlap' WHEN list_contains(covered, t.surface) THEN 'predicate_argument_overlap'
      WHEN len(list_filter(rel_words, lambda x: x <> t.surface)) <> len(list_distinct(list_filter(rel_words, lambda x: x <> t.surface))) OR list_has_any(list_filter(rel_words, lambda x: x <> t.surface), coalesce(covered, [])) THEN 'predicate_piece_overlap' END AS reason_code
  FROM rec3 LEFT JOIN size ON doc = size.document_id AND si = size.sentence_index LEFT JOIN t ON t.document_id = doc AND t.sentence_index = si AND t.terminal_index = pt
  LEFT JOIN args USING (rid) LEFT JOIN base USING (rid) LEFT JOIN late USING (rid) LEFT JOIN link USING (rid) LEFT JOIN rel USING (rid)),
good AS (SELECT * FROM out_ WHERE reason_code IS NULL),
role_word AS (SELECT rid, i, CASE WHEN list_contains(piece, i - 1) THEN 'I-' ELSE 'B-' END || model AS tag FROM (SELECT rid, model, piece, unnest(piece) AS i FROM (SELECT rid, model, unnest(once) AS piece FROM arg SEMI JOIN good USING (rid)))
  UNION ALL SELECT rid, surface, 'B-V' FROM good
  UNION ALL SELECT rid, i, CASE WHEN list_contains(piece, i - 1) THEN 'I-C-V' ELSE 'B-C-V' END FROM (SELECT rid, piece, unnest(piece) AS i FROM (SELECT rid, list_filter(unnest(rel_pieces), lambda x: x <> surface) AS piece FROM good))),
tagged AS (SELECT good.rid, record_id, w.surface AS pos, coalesce(tag, 'O') AS tag FROM good JOIN t w ON w.document_id = good.document_id AND w.sentence_index = good.sentence_index AND w.surface >= 0 LEFT JOIN role_word ON role_word.rid = good.rid AND role_word.i = w.surface)"""

#: The same conversions written out, one row each.
PROVENANCE = r""",
role_text AS (SELECT rid, string_agg(concat_ws('|', label, model, coalesce(CASE WHEN core THEN nullif(regexp_extract(label, '^(?:C-|R-)?ARG(?:[0-9]+|A)-(.+)$', 1), '') ELSE regexp_extract(label, 'ARGM-(.+)$', 1) END, ''), raw,
    array_to_string(list_transform(once, lambda x: array_to_string(x, ',')), ';')), ' ' ORDER BY k) AS roles,
    coalesce(string_agg(rtrim(repeat('duplicate_pointer_deduplicated:' || number || ' ', len(pieces) - len(once))), ' ' ORDER BY k) FILTER (WHERE len(pieces) > len(once)), '') AS warnings FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k) - 1 AS number FROM arg SEMI JOIN good USING (rid)) GROUP BY rid),
link_text AS (SELECT rid, string_agg(label, ' ' ORDER BY k) AS links FROM item3 SEMI JOIN good USING (rid) WHERE sort = 'link' GROUP BY rid),
word_text AS (SELECT document_id, sentence_index, string_agg(CASE WHEN surface >= 0 THEN surface::VARCHAR ELSE '-' END, ' ' ORDER BY terminal_index) AS terminal_to_word FROM t GROUP BY ALL)
SELECT record_id, raw_line, good.document_id, CASE WHEN typed THEN 'modern' ELSE 'classic' END AS dialect, predicate_terminal, pos AS predicate_pos, terminal_to_word, array_to_string(list_sort(list_distinct(rel_words)), ' ') AS predicate_words,
  coalesce(roles, '') AS roles, coalesce(links, '') AS link_labels, coalesce(warnings, '') AS warnings
FROM good JOIN word_text USING (document_id, sentence_index) LEFT JOIN role_text USING (rid) LEFT JOIN link_text USING (rid)"""
