import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbatlas.operators import skew
from verbatlas.sources import records

WORDS = "mail-1:0:1,mail-1,r1,Ann sent it .,1,B-ARG0 B-V B-ARG1 O,send.01"


def parse(spark, *lines, **options):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_id long, line string")
    return records.parse_records(rows, **options).orderBy("line_id", "record_no").collect()


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (WORDS, None), (WORDS.replace("send.01", '"send.01"'), None), (WORDS.replace(",1,", ", 01 ,"), None), (WORDS.replace("it .", 'it "".""').replace("Ann", '"Ann').replace(',1,', '",1,', 1), None),
        ('mail-1:0:1,mail-1,r1,"Ann, sent\nit ""now"" .",1,O B-V O O,send.01', None),
        (WORDS.replace("it", 'i"t'), "quoting"), (WORDS.replace("send.01", '"send.01'), "quoting"), (WORDS.replace("mail-1,r1", '"mail-1" ,r1'), "quoting"), (WORDS.replace("mail-1,r1", ' "mail-1",r1'), "quoting"),
        (WORDS + ",", "columns"), ("", "columns"), (None, "columns"), (WORDS.replace(",1,", ","), "columns"),
        (WORDS.replace(",1,", ",4,"), "predicate_index"), (WORDS.replace(",1,", ",-1,"), "predicate_index"), (WORDS.replace(",1,", ",٣,"), "predicate_index"), (WORDS.replace(",1,", "," + "9" * 30 + ","), "predicate_index"),
        (WORDS.replace("Ann sent it .", ""), "predicate_index"), (WORDS.replace(",1,", ',"1 ",'), "predicate_index"),
        (WORDS.replace("send.01", "send.1"), "predicate_roleset"), (WORDS.replace("send.01", ""), "predicate_roleset"), (WORDS.replace("send.01", "se2nd.01"), "predicate_roleset"), (WORDS.replace("send.01", "take_off-x.01"), None),
    ],
)
def test_reasons(spark, line, reason):
    (row,) = parse(spark, line)
    assert row.reason == reason
    if reason is None:
        assert row.predicate_index == 1 and row.words[0].startswith("Ann")
    else:
        assert row.error and row.error_at is not None


def test_a_broken_quote_costs_one_record(spark):
    text = "\n".join([WORDS, WORDS.replace("Ann", '"Ann'), WORDS.replace("mail-1", "mail-2"), WORDS.replace("mail-1", "mail-3").replace("Ann sent", '"Ann\nsent').replace(" .", ' ."')])
    found = parse(spark, text, lines=True)
    assert [r.reason for r in found] == [None, "quoting", None, None]
    assert [r.document_id for r in found] == ["mail-1", None, "mail-2", "mail-3"] and found[3].words[0] == "Ann\nsent"
    assert found[1].raw.startswith("mail-1") and found[1].error_at == found[1].raw.index('"')


def test_loaded_and_rejected_are_all_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, WORDS if i % 3 else "x") for i in range(30)], "line_id long, line string")
    good, bad = records.split_good_and_bad(records.parse_records(rows))
    assert (good.count(), bad.count()) == (20, 10)
    (tmp_path / "a.csv").write_text(f"{WORDS}\n{WORDS}\n", encoding="utf-8")
    assert records.read_record_files(spark, str(tmp_path / "a.csv")).where("reason is null").count() == 2
    assert records.parse_records(rows.limit(0)).count() == 0


def skewed(seed=1, n=3000):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *"uvwxyz"]), rng.choice([None, *range(40)])) for _ in range(n)]


def test_per_key_results_against_brute_force(spark):
    rows = [*skewed(), ("alone", None, None), ("tie", "b", 1), ("tie", "a", 2)]
    df = spark.createDataFrame(rows, "k string, c string, m int")
    found = {r.key: r for r in skew.profile(df, "k", "c", F.col("m"), {"p50": 0.5, "p90": 0.9, "p100": 1.0}).collect()}
    assert set(found) == {k for k, _, _ in rows if k is not None}
    for key, row in found.items():
        values = Counter(c for k, c, _ in rows if k == key and c is not None)
        numbers = sorted(m for k, _, m in rows if k == key and m is not None)
        at = lambda p: numbers[max(1, -(-int(p * 1000) * len(numbers) // 1000)) - 1] if numbers else None
        assert row.rows == sum(k == key for k, _, _ in rows) and row.distinct == len(values)
        assert row["mode"] == (min(values, key=lambda v: (-values[v], v)) if values else None)
        assert (row.p50, row.p90, row.p100) == (at(0.5), at(0.9), at(1.0))


def test_heavy_keys(spark):
    df = spark.createDataFrame(skewed(), "k string, c string, m int")
    found = {(r.key_field, r.key_value) for r in skew.heavy_keys(df, ["k", "c"], 0.12).collect()}
    rows = skewed()
    expected = {(f, v) for i, f in enumerate("kc") for v, n in Counter(r[i] for r in rows).items() if v is not None and n >= 0.12 * len(rows)}
    assert found == expected and skew.heavy_keys(df.limit(0), ["k"], 0.05).count() == 0


def test_skipped_lines_are_records_of_their_own(spark):
    text = "\n".join([WORDS, WORDS.replace("Ann", '"Ann'), "loose", "", ' "mail-2:0:1" , mail-2 ,' + WORDS.split(",", 2)[2], "mail-3:0:1, mail-3 ," + WORDS.split(",", 2)[2]])
    found = parse(spark, text, lines=True)
    assert [(r.reason, r.raw) for r in found[1:4]] == [("quoting", WORDS.replace("Ann", '"Ann')), ("quoting", "loose"), ("quoting", "")]
    assert [r.reason for r in found] == [None, "quoting", "quoting", "quoting", "quoting", None] and found[5].document_id == "mail-3"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_files_are_cut_at_record_starts(spark, tmp_path, seed, monkeypatch):
    """Blocks of any size give what one pass over the whole file gives."""
    rng = random.Random(seed)
    monkeypatch.setattr(records, "CHUNK", 100)
    kinds = [WORDS, WORDS.replace("Ann", '"Ann'), WORDS.replace("Ann sent", '"Ann\n\nsent').replace(" .", ' ."'), "loose", "", 'x,"y', WORDS.replace("Ann sent", '"Ann\nsent'), WORDS.replace("it", "it\r")]
    text = "\n".join(rng.choice(kinds).replace("mail-1", f"mail-{i}") for i in range(150)) + "\n"
    (tmp_path / "r.csv").write_bytes(text.encode())
    whole = [(r.reason, r.raw, r.document_id) for r in parse(spark, text, lines=True)]
    for size in (137, 1000, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows = records.read_record_files(spark, str(tmp_path / "r.csv")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert Counter((r.reason, r.raw, r.document_id) for r in rows) == Counter(whole)
        assert len({r.block for r in rows}) > 1 or size > 5000
