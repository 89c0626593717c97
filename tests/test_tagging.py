import itertools

import pytest
from pyspark.sql import functions as F

from verbatlas.operators import bio, evaluate, examples


def rows(spark, *tags):
    return spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "id int, tags array<string>")


def plain_repair(tags):
    out, before = [], "O"
    for t in tags:
        out.append("B" + t[1:] if t[0] == "I" and before[1:] != t[1:] else t)
        before = t
    return out


def plain_spans(tags):
    spans = []
    for i, t in enumerate(tags):
        if t[0] == "B":
            spans.append([t[2:], i, i + 1])
        elif t[0] == "I":
            spans[-1][2] = i + 1
    return [tuple(s) for s in spans]


def test_repair_and_decode_all_short_sequences(spark):
    every = [list(s) for n in range(5) for s in itertools.product(["O", "B-A", "I-A", "B-B-x", "I-B-x"], repeat=n)]
    found = bio.decoded(rows(spark, *every)).withColumn("r", bio.repair(F.col("tags"))).orderBy("id").collect()
    for tags, row in zip(every, found):
        assert row.r == plain_repair(tags) and row.error is None
        assert [tuple(s) for s in row.spans] == plain_spans(plain_repair(tags))
        assert row.repaired == sum(a != b for a, b in zip(tags, row.r))


def test_strict_and_malformed(spark):
    found = bio.decoded(rows(spark, ["O", "I-ARG1"], ["ARG1"], ["B-"], None, [None], ["B-ARG0", "I-ARG0"]), repair_tags=False).orderBy("id").collect()
    assert [r.error for r in found] == ["invalid I-tag transition at word 1", "invalid BIO tag at word 0", "invalid BIO tag at word 0", None, "invalid BIO tag at word 0", None]
    assert found[0].spans == [] and found[3].spans == [] and found[5].spans[0].end == 2


def pairs(spark, *values):
    return spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(values)], "id int, gold_tags array<string>, pred_tags array<string>")


def test_scores(spark):
    d = pairs(spark, (["B-ARG0", "B-V", "B-ARG1", "I-ARG1", "O"], ["I-ARG0", "B-V", "B-ARG1", "O", "B-ARGM-TMP"]))
    r = evaluate.score_labeled_spans(d).first()
    assert (r.true_positives, r.predicted, r.gold, r.repaired_prediction_tags) == (1, 3, 2, 1)
    assert (r.precision, r.recall, round(r.f1, 9)) == (1 / 3, 0.5, 0.4)
    assert evaluate.score_labeled_spans(pairs(spark, (["O"], ["O"]))).first().f1 == 0.0
    assert evaluate.score_labeled_spans(pairs(spark)).first().gold == 0
    assert {x.label: x.true_positives for x in evaluate.score_by_role(d).collect()} == {"ARG0": 1, "ARG1": 0, "ARGM-TMP": 0}
    assert evaluate.token_accuracy(d).first().accuracy == 0.4
    everything = evaluate.score_labeled_spans(d, excluded=()).first()
    assert everything.true_positives == 2


def test_bad_rows(spark):
    d = pairs(spark, (["O"], ["O", "O"]), (["I-A"], ["O"]), (["B-A"], ["B-A"]))
    with pytest.raises(Exception, match="lengths differ|I-tag"):
        evaluate.score_labeled_spans(d).collect()
    assert evaluate.score_labeled_spans(d, mode="report").first().true_positives == 1
    assert evaluate.bad_rows(d, "id").count() == 2


def test_example_validation(spark):
    schema = "example_id string, document_id string, sentence_id string, split string, words array<string>, predicate_index int, tags array<string>, predicate_roleset string"
    good = ("e", "d", "s", "train", ["a", "b"], 1, ["O", "B-V"], "go.01")
    change = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(schema.split(", "), good))
    cases = {
        None: good, "split_invalid": change(split="dev"), "example_id_empty": change(example_id=" "), "words_empty": change(words=[]), "word_empty": change(words=["a", ""]),
        "predicate_index_out_of_range": change(predicate_index=2), "length_mismatch": change(tags=["B-V"]), "tag_invalid": change(tags=["X", "B-V"]),
        "transition_invalid": change(tags=["I-A", "B-V"]), "predicate_tag_missing": change(tags=["B-V", "O"]), "predicate_tag_count_invalid": change(tags=["B-V", "B-V"]),
        "roleset_empty": change(predicate_roleset=None),
    }
    found = examples.validated(spark.createDataFrame(list(cases.values()), schema), with_split=True).collect()
    assert [r.reason_code for r in found] == list(cases)


def test_splits(spark):
    p = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", "d3")], "example_id string, document_id string")
    m = spark.createDataFrame([("d1", "train"), ("d2", "other")], "document_id string, split string")
    found = {r.example_id: (r.split, r.split_error) for r in examples.with_splits(p, m).collect()}
    assert found == {"a": ("train", None), "b": (None, "split_invalid"), "c": (None, "split_invalid")}
