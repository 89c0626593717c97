import pytest
from pyspark.sql import functions as F

from verbatlas.llm import mojibake as M


@pytest.mark.parametrize("word", ["café", "naïve", "Łódź", "“", "O’Neil", "Грелов", "山橋"])
@pytest.mark.parametrize("chain", [("cp1252",), ("latin-1",), ("cp437",), ("mac_roman",), ("cp1251",), ("iso8859-15",), ("cp1252", "cp1252"), ("cp1252", "cp1252", "cp1252"), ("latin-1", "cp1252")])
def test_garbling_and_back(word, chain):
    form = word
    for name in chain:
        form = M.garble(form, name)
    assert word in M.originals(form)
    if len(chain) <= 3:
        assert form in M.forms(word)


def test_clean_words_stay():
    for word in ["café", "SÃO", "DÈÑUTIY", "Ålund", "€75", "½", "§4", "Fèšomux", "Грелов-Tebafoo", "…", "VAREŠOX", "plain", "PEMÅŠEE", "HÏÑAVAA", "µm"]:
        assert M.originals(word) == {}, word
    assert M.originals("habã¶ä·iv") == {"haböķiv": "cp1252>lower"}


def tables(spark, examples, terminals):
    e = spark.createDataFrame(examples, "example_id string, words array<string>")
    t = spark.createDataFrame(terminals, "document_id string, sentence_index int, terminal_index int, word string")
    return e.selectExpr("*", "1 as word", "2 as n"), t.selectExpr("*", "'x' as form")


def test_damaged_words_of_both_tables(spark):
    examples = [("d:0:1", ["Ann", "cafÃ©", None, "crème"]), ("d:0:1", ["Ann", "cafÃ©", None, "crème"]), ("d:1:0", ["cr�me", "x�y", "SÃO"]), (None, ["cafÃ©"]), ("d:2:0", None), ("d:3:0", []), ("d:4:0", ["", "é" * 3000])]
    terminals = [("d", 0, 1, "cafГ©"), ("d", 0, 2, None), ("d", 0, 1, "cafГ©"), ("d", 1, 0, "unseenÃ¶"), ("d", None, 0, "cafÃ©"), ("d", 5, 0, "café"), ("d", 6, 0, "café")]
    found = {(r.table_name, r.record_id, r.word_pos): r.restored for r in M.restore(*tables(spark, examples, terminals)).collect()}
    assert found == {
        ("srl_examples", "d:0:1", 1): "café", ("srl_examples", "d:1:0", 0): "crème", ("srl_examples", "d:1:0", 1): None,
        ("penn_terminals", "d:0", 1): "café", ("penn_terminals", "d:1", 0): "unseenö"}


def test_ambiguous_losses_and_empty_tables(spark):
    found = M.restore(*tables(spark, [("a:0:0", ["r�d", "réd", "ród", "ród"])], [])).collect()
    assert [(r.word, r.restored) for r in found] == [("r�d", None)]
    assert M.restore(*tables(spark, [], [])).count() == 0


def test_every_reported_word_joins_the_form_of_an_original_or_has_lost_bytes(spark):
    """Decoding only proposes: what it proposes must give the word when garbled again."""
    clean = ["Käse", "Straße", "naïve", "Þórr", "ναι", "café"]
    garbled = [M.garble(w, c) for w in ("Größe", "señor", "Łódź") for c in M.CODECS] + [M.garble(M.garble("über", "cp437"), "cp1252"), M.garble(M.garble("über", "cp1252"), "cp850")]
    lower = [M.garble(w, "cp1252").lower() for w in ("fêt", "fõt", "fút")]
    lost = ["caf�", "x��y", "K?se", "what?", "?"]
    words = spark.createDataFrame([(w, 1) for w in dict.fromkeys(clean + garbled + lower + lost)], "word string, n long")
    found = {r.word: (r.restored, r.chain) for r in M.damaged_words(words).collect()}
    assert set(garbled) | set(lower) | {"caf�", "x��y", "K?se"} == set(found)
    for word, (restored, chain) in found.items():
        assert restored is None and chain == "lost" or word in M.forms(restored)
    assert found["caf�"][0] == "café" and found["K?se"] == ("Käse", "lost:question") and found["x��y"] == (None, "lost")
    assert {found[w][0] for w in lower} == {"fêt", "fõt", "fút"} and found[garbled[-1]][0] == found[garbled[-2]][0] == "über"


def test_some_proposal_gives_the_form_again():
    """Not every proposal does (codecs share most letters); those that do not join nothing."""
    for word in ("Größe", "señor", "Łódź", "don’t", "ναι"):
        for form in M.forms(word):
            proposals = M.originals(form)
            if proposals and M.LOST not in form:
                assert any(form in M.forms(original) for original in proposals), form


def test_long_words(spark):
    long = "ä" + "xö" * 30_000
    words = spark.createDataFrame([(long, 1), (M.garble(long, "cp1252"), 1), (M.garble("ü" * 5000, "cp437"), 1)], "word string, n long")
    found = {r.word: (r.restored, r.chain) for r in M.damaged_words(words).collect()}
    assert found == {M.garble(long, "cp1252"): (long, "cp1252"), M.garble("ü" * 5000, "cp437"): ("ü" * 5000, "cp437")}


def test_forms_are_never_broadcast(spark):
    """Spark takes the forms for as many as their originals; those of a thoroughly garbled corpus broke the driver."""
    garbled = {}
    for k in range(20):
        original = form = "é" * 1000 + str(k)
        for _ in range(3):
            form = M.garble(form, "cp1252")
            garbled[form] = original
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        words = spark.createDataFrame([(w, 1) for w in garbled], "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        damaged = M.damaged_words(words)
        assert {r.word: r.restored for r in damaged.collect()} == garbled
        assert "BroadcastExchange" not in damaged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
