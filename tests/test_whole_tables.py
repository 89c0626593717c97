from verbatlas.operators import propositions, trees
from verbatlas.plans import corpus, trees_and_records as plans

LEAF = "document_id string, sentence_index int, terminal_index int, word string, pos string, preterminal_path array<int>"


def leaves(*sentences):
    return [("d", n, t, word, pos, [0, t]) for n, sentence in enumerate(sentences) for t, (word, pos) in enumerate(sentence)]


def test_sentences_with_brackets_blanks_and_nulls_are_kept(spark):
    rows = leaves([("(", "("), ("a b c", "NN"), (")", ")")], [(None, "NN"), ("x", None), ("", "NN")], [("plain", "NN")])
    found = plans.parsed_terminals(spark.createDataFrame(rows, LEAF))
    assert {r.sentence_index: r.tree_error for r in found.collect()} == {0: None, 1: None, 2: None}
    long = {(r.sentence_index, r.t): (r.word, r.pos, r.surface) for r in trees.terminals_long(found, "document_id", "sentence_index").collect()}
    assert long == {
        (0, 0): ("-LRB-", "-LRB-", 0), (0, 1): ("a_b_c", "NN", 1), (0, 2): ("-RRB-", "-RRB-", 2),
        (1, 0): ("-NULL-", "NN", 0), (1, 1): ("x", "-NULL-", 1), (1, 2): ("-EMPTY-", "NN", 2), (2, 0): ("plain", "NN", 0),
    }


def test_sentences_with_missing_or_repeated_leaves_have_an_error(spark):
    rows = [("d", 0, 1, "b", "NN", [0]), ("d", 1, 0, "a", "NN", [0]), ("d", 1, 0, "b", "NN", [1]), ("d", 1, 2, "c", "NN", [2]), ("d", 2, 0, "a", "NN", None)]
    found = plans.parsed_terminals(spark.createDataFrame(rows, LEAF))
    assert {r.sentence_index: r.tree_error for r in found.collect()} == dict.fromkeys(range(3), "tree_terminals_incomplete")


def test_every_example_has_a_record_and_a_reason(spark):
    words = [("Ann", "NNP"), ("ships", "VBZ"), ("it", "PRP")]
    parsed = plans.parsed_terminals(spark.createDataFrame([*leaves(words), ("d", 1, 1, "x", "NN", [1])], LEAF)).cache()
    full, tags = ["Ann", "ships", "it"], ["B-ARG0", "B-V", "B-ARG1"]
    examples = [
        ("d:0:1", full, 1, tags, "ship.01", None), ("d:0:2", full, 1, tags, "ship_off.06", None), ("d:0:3", full, 1, tags, None, "roleset_invalid"),
        ("d:7:4", full, 1, tags, "ship.01", "sentence_index_out_of_range"), ("d:1:5", full, 1, tags, "ship.01", "tree_terminals_incomplete"),
        ("d:0:6", full[:2], 1, tags[:2], "ship.01", "example_word_count_mismatch"), ("d:0:7", full, 1, ["B-ARG0", "V", "O"], "ship.01", "example_tags_invalid"),
        ("d:0:8", full, 1, tags[:2], "ship.01", "example_tags_invalid"), ("d:0:9", full, 3, tags, "ship.01", "record_index_invalid"),
        ("d", full, 1, tags, "ship.01", "record_index_invalid"), ("d:0:10", None, 1, None, "ship.01", "example_tags_invalid"),
    ]
    rows = spark.createDataFrame([(e[0], "d", *e[1:5]) for e in examples], "example_id string, document_id string, words array<string>, predicate_index int, tags array<string>, predicate_roleset string")
    records = plans.example_records(rows, parsed).cache()
    lines = {r.example_id: r.raw_line for r in records.collect()}
    assert set(lines) == {e[0] for e in examples} and lines["d:0:2"] == "d 0 1 gold ship_off-v ship_off.06 ----- 0:0-ARG0 1:0-rel 2:0-ARG1"
    found = propositions.conversion_rows(records, parsed)
    assert sorted((r.raw_line, r.reason_code or "") for r in found.collect()) == sorted((lines[e[0]], e[5] or "") for e in examples)
    assert {r.reason_code: r.records for r in propositions.coverage(found).collect()}[None] == 2


def test_layers_take_all_documents(spark, tmp_path):
    examples = [("mail-3", "go.01"), ("mail-1", "ship.01"), ("mail-1", None), ("mail-2", None)]
    spark.createDataFrame(examples, "document_id string, predicate_roleset string").write.parquet(f"{tmp_path}/srl_examples.parquet")
    spark.createDataFrame([("mail-1",), ("mail-3",), ("mail-4",)], "document_id string").write.parquet(f"{tmp_path}/penn_terminals.parquet")
    assert {r.document_id for r in corpus.layer_join(spark, str(tmp_path)).collect()} == {"mail-1", "mail-3"}
    assert {tuple(r) for r in corpus.missing_layers(spark, str(tmp_path)).select("layer", "document_id").collect()} == {("prop", "mail-2"), ("ptb", "mail-2"), ("text", "mail-4"), ("prop", "mail-4")}
    assert {r.layer: r.files for r in corpus.layer_summary(spark, str(tmp_path)).collect()} == {"text": 3, "ptb": 3, "prop": 2}
