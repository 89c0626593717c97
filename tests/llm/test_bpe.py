import random

import pytest
from tokenizers import Tokenizer

from verbatlas.llm import bpe

TEXTS = [
    None, "", "   ", "Hello world", "don't I'LL we've 's 'sabc ''s x's's", "<|endoftext|> a<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaa", "a" * 20_000, "\n\n  x \t\r\n y", "½ ² ⅷ ١٢",
    "🎉🎉 👩‍👩‍👧 é é ﷺ 漢字カナ", "\x00\x1c\x1d\x85  　", "𝒳y 𝟘", "x" * 5000 + " " * 300 + "\n", "Ünïcödé-Wörter – „deutsch“", "!?" * 50,
]


@pytest.fixture(scope="module")
def reference():
    found = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_public_tokenizer(spark, reference):
    rng = random.Random(2)
    letters = "ab'strvemld  \n\t12½é!.’\x85漢🎉 "
    texts = [*TEXTS, *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in bpe.encode_documents(df).collect():
        assert row.ids == reference(texts[row.doc_id]), repr(texts[row.doc_id][:60])
    for row in bpe.count_tokens(df).collect():
        assert row.n_tokens == len(reference(texts[row.doc_id]))


def test_forgetting_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    coder = bpe.Encoder(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    for text in ["one two three", "four five six seven", "one two"]:
        assert coder.encode([text])[0].tolist() == reference(text)


def test_defined_ids_and_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (3, " ")], "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as n_tokens")
    found = bpe.encode_documents(df, null_ids=[7], empty_ids=[8, 9]).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == [(1, [7]), (2, [8, 9]), (3, [220]), (3, [220])]
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_decoding_gives_the_text_back(reference):
    coder = bpe.Encoder(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    back = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    for text in filter(None, TEXTS):
        assert back.decode(coder.encode([text])[0].tolist(), skip_special_tokens=False) == text
