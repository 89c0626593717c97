import datetime as dt
import json

import pytest

from verbatlas import cli
from verbatlas.sources import records
from verbatlas.streaming import actions as S


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name).collect()


def test_lemma_counts_per_window(spark, tmp_path):
    day = lambda d: dt.datetime(2025, 1, d, 12)
    rows = [(1, "Please call Bo.", day(1)), (2, "Ann called and wrote.", day(1)), (3, "Bo will call.", day(3))]
    spark.createDataFrame(rows, "doc_id long, text string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, at timestamp").parquet(str(tmp_path / "in"))
    found = {(r.window.start.day, r.lemma): r.candidates for r in drain(S.lemma_counts(stream, "at"), "lemmas", "complete")}
    assert found == {(1, "call"): 2, (1, "write"): 1, (3, "call"): 1}


def test_record_stream_equals_batch(spark, tmp_path):
    lines = ["d:0:1,d,s,Ann sent it,1,O B-V O,send.01", "x", None, 'd:0:1,d,s,"Ann']
    spark.createDataFrame(list(enumerate(lines)), "line_id long, line string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line_id long, line string").parquet(str(tmp_path / "in"))
    batch = records.parse_records(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert sorted(map(str, drain(S.record_stream(stream), "parsed", "append"))) == sorted(map(str, batch))


def test_extract_command(spark, capsys, tmp_path):
    assert cli.main(["extract", "Please", "call", "Bo."]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["actions"][0]["predicate_lemma"] == "call" and found["actions"][0]["actor"] is None
    (tmp_path / "a.txt").write_text("Ann sent it to Zoë.", encoding="utf-8")
    assert cli.main(["extract", "--input-file", str(tmp_path / "a.txt"), "--pretty"]) == 0
    assert "Zo" in capsys.readouterr().out
    for bad in (["extract", " "], ["extract", "--input-file", "/nowhere"], ["extract", "a", "--input-file", "b"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
