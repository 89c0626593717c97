import random

import pytest

from verbatlas.llm import spans

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None:
            texts.setdefault(i, set()).add(t)
    owners = {}
    for i, ts in texts.items():
        for t in ts:
            for k in range(len(t) - length + 1):
                owners.setdefault(t[k : k + length], set()).add(i)
    found = set()
    for i, ts in texts.items():
        marked = set()
        for t in ts:
            for k in range(len(t) - length + 1):
                if len(owners[t[k : k + length]]) > 1:
                    marked.update(range(k, k + length))
        for k in sorted(marked):
            if k - 1 not in marked:
                end = k
                while end in marked:
                    end += 1
                found.add((i, k, end))
    return found


def corpus(seed, n=25):
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choice("abc é🎉\n") for _ in range(k))
    shared = [piece(rng.randrange(10, 90)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([piece(rng.randrange(30)), rng.choice(shared)]) for _ in range(rng.randrange(6)))) for i in range(n)]
    return [*rows, (100, None), (101, ""), (None, shared[0]), (102, "a" * 300), (103, "a" * 200), (104, "xy" * 90), (105, rows[3][1]), (105, rows[3][1]), (106, "b" * 90 + "c" + "b" * 90)]


@pytest.mark.parametrize(("seed", "hot"), [(1, 5000), (2, 5000), (3, 1), (4, 1)])
def test_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as mini", "2 as id", "3 as packed")
    found = spans.shared_spans(df, length=40, word=17, hot=hot).collect()
    assert {tuple(r) for r in found} == brute(rows, 40) and len(found) == len(brute(rows, 40))


def test_production_length_and_amounts(spark):
    rng = random.Random(9)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = text(170)
    rows = [(1, text(50) + passage + text(60)), (2, passage), (3, text(200)), (4, passage[:149]), (5, passage[:150]), (6, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = spans.shared_spans(df)
    assert {tuple(r) for r in found.collect()} == {(1, 50, 220), (2, 0, 170), (5, 0, 150)} == brute(rows, 150)
    amounts = {r.doc_id: (r.chars, r.shared_chars, r.spans) for r in spans.shared_amount(df, found).collect()}
    assert amounts[1] == (280, 170, 1) and amounts[6] == (0, 0, 0) and amounts[3] == (200, 0, 0)
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_a_passage_in_many_contexts_makes_no_large_bucket(spark, monkeypatch):
    """One passage shorter than a window by little, in contexts that differ: all its super-k-mers have one minimiser."""
    rng = random.Random(11)
    letters = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = letters(140)
    contexts = [(letters(9), letters(9)) for _ in range(3)]
    rows = [(i, letters(30) + passage + letters(30)) for i in range(600)]
    rows += [(1000 + i, letters(5) + left + passage + right + letters(5)) for i, (left, right) in enumerate(contexts * 2)]
    hot, largest, counted = 50, [], spans.count_in_buckets

    def watched(strings, length):
        largest.append(strings.groupBy("mini", "sub").count().agg({"count": "max"}).first()[0] or 0)
        return counted(strings, length)

    monkeypatch.setattr(spans, "count_in_buckets", watched)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = spans.shared_spans(df, hot=hot).collect()
    assert {tuple(r) for r in found} == brute(rows, 150) and len(found) >= 6
    assert max(largest) <= hot
