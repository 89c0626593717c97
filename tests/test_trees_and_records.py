import random

import pytest

from verbatlas.operators import align, propositions as P, trees as T
from verbatlas.plans.trees_and_records import fixed_pieces

T1 = "(TOP (S (NP-SBJ (NNP Ines)) (VP (VBD shipped) (NP (-NONE- *T*-1)) (NP (DT the) (NN crate))) (. .)))"
HEAD = "demo/x.parse 0 1 gold ship-v ship.01 ----- "


def parsed(spark, *sources, single=True):
    rows = [("demo/x.parse", i, s) for i, s in enumerate(sources)]
    return T.parse_trees(spark.createDataFrame(rows, "document_id string, sentence_index int, source string"), "source", "document_id", "sentence_index", single=single)


def test_terminals_and_surface(spark):
    rows = T.terminals_long(parsed(spark, T1)).collect()
    assert [r.word for r in rows] == ["Ines", "shipped", "*T*-1", "the", "crate", "."]
    assert [r.surface for r in rows] == [0, 1, None, 2, 3, 4]
    assert [r.path for r in T.preterminal_paths(parsed(spark, f"( {T1} )")).collect()][2] == [0, 1, 1, 0]


@pytest.mark.parametrize(
    ("source", "code"),
    [("", "tree_source_empty"), (None, "tree_source_empty"), ("(A (B c)) x", "tree_syntax_invalid"), ("(A (B c)", "tree_syntax_invalid"), ("(A ((B c)))", "nested_unlabeled_wrapper_invalid"),
     ("((A b) (C d))", "unlabeled_tree_wrapper_invalid"), ("(A b (C d))", "tree_structure_invalid"), ("(A b c)", "tree_structure_invalid"), ("(A)", "tree_structure_invalid"),
     ("()", "tree_syntax_invalid"), ("(A b) (C d)", "tree_count_invalid")],
)
def test_tree_errors(spark, source, code):
    assert parsed(spark, source).first().tree_error == code


def test_random_trees_round_trip():
    rng = random.Random(3)

    def grow(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"({rng.choice(['NN', '-NONE-'])} w{rng.randrange(9)})"
        return f"(X {' '.join(grow(depth - 1) for _ in range(rng.randint(1, 3)))})"

    for _ in range(200):
        (nodes, terminals), = T.scan_trees(grow(5))
        assert nodes[0][0] == 0 and nodes[0][3] == len(terminals) == sum(n[1] in ("NN", "-NONE-") for n in nodes)
        for level, _, lt, nt in nodes:  # children tile their parent
            inner = [n for n in nodes if n[0] == level + 1 and lt <= n[2] < lt + nt]
            assert not inner or sum(n[3] for n in inner) == nt


def test_balanced_counts(spark):
    rows = spark.createDataFrame([(0, f"{T1}\n{T1}"), (1, "a)"), (2, "(a"), (3, "x"), (4, "(a (b))"), (5, None)], "id int, s string")
    found = {r.id: (r.terminals, r.tree_error) for r in T.balanced_counts(rows, "s", "id").collect()}
    assert found == {0: ([6, 6], None), 1: (None, "unmatched_closing_parenthesis"), 2: (None, "unclosed_parenthesis"), 3: (None, "no_balanced_trees"), 4: (None, "tree_without_terminal"), 5: (None, "no_balanced_trees")}


@pytest.mark.parametrize(
    ("raw", "error", "members"),
    [("0:1", None, 1), ("2:1*3:1", None, 2), ("1:0,2:0", None, 1), ("", "pointer_empty", None), ("2:1;4:1*3:1", "mixed_semicolon_chain_unsupported", None),
     ("1:0;2:0,3:0", "mixed_concatenation_unsupported", None), ("1-0", "pointer_syntax_invalid", None), (None, "pointer_empty", None)],
)
def test_pointers(spark, raw, error, members):
    r = P.parse_pointers(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert r.pointer_error == error and (r.members is None) == (members is None) and (members is None or len(r.members) == members)


CASES = [
    ("0:1-ARG0 1:0-rel 3:1-ARG1", None, "B-ARG0 B-V B-ARG1 I-ARG1 O"),
    ("0:1-ARG0 1:0-rel 2:1*3:1-ARG1", None, "B-ARG0 B-V B-ARG1 I-ARG1 O"),
    ("0:1-ARG0 1:0-rel 3:1,3:1-ARG1", None, "B-ARG0 B-V B-ARG1 I-ARG1 O"),
    ("0:1-ARG0-xy 1:0,3:0-rel", None, "B-ARG0 B-V B-C-V O O"),
    ("0:1-ARG0 1:0-rel 3:0,4:0-ARG1", None, "B-ARG0 B-V B-ARG1 B-ARG1 O"),
    ("0:1-ARG0 1:0-rel 2:1-ARG1", "argument_has_no_surface_realization", None),
    ("1:0-rel 0:1*3:1-ARG1", "argument_trace_chain_ambiguous", None),
    ("0:1-ARG0 0:2-ARGM-TMP 1:0-rel", "semantic_role_overlap", None),
    ("0:1-ARG0 1:0-rel 3:1,4:0-ARG1", "pointer_piece_overlap", None),
    ("0:1-ARG0 1:0-rel 3:1-C-ARG1", "continuation_role_without_base", None),
    ("0:1-ARG0 1:0-rel 3:1-R-ARG1", "reference_role_without_base", None),
    ("3:1-ARG1 1:0-rel 0:1-C-ARG1", "continuation_role_precedes_base", None),
    ("0:1-ARG0 3:0-rel", "rel_does_not_cover_predicate", None),
    ("0:1-ARG0 1:1-rel 3:1-ARG1", "predicate_piece_overlap", None),
    ("1:1-ARG0 1:0-rel", "predicate_argument_overlap", None),
    ("0:1-ARG0 1:0*3:0-rel", "predicate_chain_ambiguous", None),
    ("1:2-ARG0 1:0-rel", "pointer_height_out_of_range", None),
    ("3:2-ARG0 1:0-rel", "pointer_leftmost_terminal_mismatch", None),
    ("0:4-ARG0 1:0-rel", "pointer_height_out_of_range", None),
    ("9:0-ARG0 1:0-rel", "pointer_terminal_out_of_range", None),
    ("99999999999:0-ARG0 1:0-rel", "pointer_terminal_out_of_range", None),
    ("0:1-ARGM 1:0-rel", "argm_feature_missing", None),
    ("0:1-FOO 1:0-rel", "unsupported_role", None),
    ("0:1-ARG0 1:0-rel 2:1*3:1-LINK-XYZ", "unsupported_link_type", None),
    ("0:1-ARG0 1:0-rel 3:1-LINK-PCR", "link_chain_invalid", None),
    ("0:1-ARG0 1:0-rel 2:1*3:1-LINK-PCR", "link_argument_missing", None),
    ("0:1-ARG0 1:0-rel 3:1-ARG1 0:1*3:1-LINK-PCR", "link_argument_ambiguous", None),
    ("0:1-ARG0 1:0-rel 3:1-ARG1 2:1*3:1-LINK-PCR", None, "B-ARG0 B-V B-ARG1 I-ARG1 O"),
    ("0:1-ARG0", "predicate_label_count_invalid", None),
    ("x", "proposition_label_invalid", None),
]


def test_conversion_reasons_and_tags(spark):
    lines = [(HEAD + labels,) for labels, _, _ in CASES]
    records = P.parse_records(spark.createDataFrame(lines, "line string"))
    found = {r.raw_line: r for r in P.conversion_rows(records, parsed(spark, T1)).collect()}
    assert len(found) == len(CASES)
    for labels, code, tags in CASES:
        row = found[HEAD + labels]
        expected = code if labels != "1:2-ARG0 1:0-rel" else row.reason_code
        assert row.reason_code == expected, labels
        assert (" ".join(row.tags) if row.tags else None) == tags, labels
    assert found[HEAD + CASES[2][0]].warnings == ["duplicate_pointer_deduplicated:1"]


def test_record_reasons(spark):
    lines = {
        "": "record_empty", "a b c": "record_field_count_invalid", "demo/x.parse 0 -1 gold ship.01 vp--a 1:0-rel": "record_index_invalid",
        "demo/x.parse 0 1 gold ship-v ship.01 x 1:0-rel": "record_dialect_invalid", "demo/x.parse 0 1 gold ship.01 vp- 1:0-rel": "record_dialect_invalid",
        "demo/x.parse 0 1 gold ship vp--a 1:0-rel": "roleset_invalid", "demo/x.parse 0 1 gold ship.01 vp--a 1:0;3:0-rel": "classic_pointer_operator_unsupported",
        "demo/x.parse 0 1 gold ship.01 vp--a 1:0-rel 0:1-C-ARG0": "classic_label_unsupported", "demo/x.parse 5 1 gold ship.01 vp--a 1:0-rel": "sentence_index_out_of_range",
        "demo/x.parse 0 9 gold ship.01 vp--a 1:0-rel": "predicate_terminal_out_of_range", "demo/x.parse 0 2 gold ship.01 vp--a 1:0-rel": "predicate_has_no_surface",
        "demo/x.parse 0 0 gold ship.01 vp--a 0:0-rel": "predicate_pos_mismatch", "demo/x.parse 0 1 gold ship-n ship.01 ----- 1:0-rel": "nonverbal_type",
        "  demo/x.parse\t0 +1 gold ship.01 vp--a 1:0-rel ": None, "a/WSJ_1.x 0 1 gold ship.01 vp--a 1:0-rel": "excluded_source_wsj",
    }
    trees = parsed(spark, T1).unionByName(parsed(spark, T1).selectExpr("'a/WSJ_1.x' as document_id", "sentence_index", "tree_no", "nodes", "terminals", "tree_error"))
    records = P.parse_records(spark.createDataFrame([(x,) for x in lines], "line string"))
    found = P.conversion_rows(records, trees)
    assert {r.raw_line: r.reason_code for r in found.collect()} == {" ".join(k.split()).replace("parse 0 +1", "parse\t0 +1") if k.startswith("  ") else k: v for k, v in lines.items()}
    assert P.examples_of(found).count() + P.rejects_of(found).count() == len(lines)
    free = P.conversion_rows(records, trees, policy=P.allow_all).where("document_id like '%WSJ%'").first()
    assert free.reason_code is None


def test_alignment(spark):
    schema = "words array<string>, tags array<string>, predicate_index int, input_ids array<int>, attention_mask array<int>, word_ids array<int>"
    base = (["a", "b", "c"], ["B-ARG0", "B-V", "B-ARG1"], 1)
    rows = [(*base, [0] * 7, None, [None, 0, 1, 1, 2, 2, None]), (*base, [0] * 4, None, [None, 0, 1, None]), (*base, [0] * 3, None, [0, 2, 1]), (*base, [0] * 2, None, [0, 1, 2])]
    table = {t: i for i, t in enumerate(["O", "B-ARG0", "B-V", "I-V", "B-ARG1", "I-ARG1"])}
    found = align.align_labels(spark.createDataFrame(rows, schema), table).collect()
    assert found[0].labels == [-100, 1, 2, 3, 4, 5, -100] and found[0].token_type_ids == [0, 0, 1, 0, 0, 0, 0] and found[0].attention_mask == [1] * 7
    assert [r.align_error for r in found[1:4]] == ["align_words_omitted", "align_words_omitted", "align_ids_mismatch"]
    assert align.align_labels(spark.createDataFrame(rows[:1], schema), {"O": 0}).first().align_error == "align_label_unmapped"
    words = spark.createDataFrame([(["shipping", "it"], ["B-V", "O"], 0)], "words array<string>, tags array<string>, predicate_index int")
    row = align.model_inputs(align.align_labels(align.tokenize_words(words, fixed_pieces), {"O": 0, "B-V": 1, "I-V": 2})).first()
    assert row.labels == [-100, 1, 2, 0, -100] and row.token_type_ids == [0, 1, 0, 0, 0]


def one_label_model():
    """A model for the tests: the label of a piece is its id modulo the number of labels."""
    return lambda ids, mask, kinds: [[[float(i % 3 == k) for k in range(3)] for i in row] for row in ids]


def test_prediction_and_adapters(spark):
    rows = [("a", [5, 4, 4, 3, 5], [None, 0, 0, 1, None], [0] * 5, None), ("b", [1], [None], [0], "align_words_omitted")]
    aligned = spark.createDataFrame(rows, "id string, input_ids array<int>, word_ids array<int>, token_type_ids array<int>, align_error string").selectExpr("*", "input_ids as attention_mask")
    found = {r.id: (r.tags, r.predict_error) for r in align.predict_tags(aligned, one_label_model, ["O", "B-V", "I-V"], "id").collect()}
    assert found == {"a": (["B-V", "O"], None), "b": (None, "align_words_omitted")}
    wrong = align.predict_tags(aligned.where("id = 'a'"), one_label_model, ["O", "B-V"], "id").first()
    assert (wrong.tags, wrong.predict_error) == (None, "predict_shape_invalid")

    class Fast(dict):
        def word_ids(self):
            return [None, 0, None]

    assert align.word_numbers(Fast(input_ids=[[1, 2, 3]])) == ([1, 2, 3], [None, 0, None])
    assert align.word_numbers({"input_ids": [1, 2], "word_ids": [0, 1]}) == ([1, 2], [0, 1])
