"""Sentences and tokens with code-point offsets into the source text.

Everything is an expression on the row of a document, so the operators run inside the scan stage without a
shuffle, in batch and in streaming queries alike.

Defined results: null and empty texts have no sentences; terminators at the start of a text belong to no
sentence; a blank sentence keeps its index and has no tokens; letters beyond ASCII are no tokens, other signs
beyond ASCII are; rows delivered twice give their tokens twice. Columns of the input other than the id and the
text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences, tokens, and what is neither a word character nor white space.
SENTENCE = r"[^.!?]+[.!?]*"
WORD = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"
SIGN = r"[^\p{L}\p{N}\p{Z}_\t\n\x0B\f\r\x1c-\x1f\x85]"

TOKEN = f"{WORD}|{SIGN}"


def running_starts(pieces: Column, gaps: Column, first: Column) -> Column:
    """Where each piece of a text starts: ``gaps`` are the lengths of what stands before each of them."""
    zero = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("starts"))
    sizes = F.zip_with(gaps, pieces, lambda g, p: F.struct(g.alias("gap"), F.char_length(p).alias("size")))
    return F.aggregate(
        sizes,
        zero,
        lambda acc, s: F.struct((acc["at"] + s["gap"] + s["size"]).alias("at"), F.array_append(acc["starts"], acc["at"] + s["gap"]).alias("starts")),
        lambda acc: acc["starts"],
    )


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column behind a generator of one row.

    The optimizer puts the expression of a projected column into every filter and lambda that names it, where
    it would be computed again and again; it never does so through a generator.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sentence_index, sentence, start, end)``."""
    pieces = F.regexp_extract_all(F.col("t"), F.lit(SENTENCE), F.lit(0))
    lead = F.char_length(F.regexp_extract("t", r"^[.!?]*", 0))
    rows = documents.select(F.col(id_col), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    rows = rows.select(id_col, pieces.alias("p"), lead.alias("lead"))
    gaps = F.transform("p", lambda _: F.lit(0))
    zipped = F.arrays_zip(F.col("p").alias("sentence"), running_starts(F.col("p"), gaps, F.col("lead")).alias("start"))
    return rows.select(id_col, F.posexplode(zipped).alias("sentence_index", "s")).select(
        id_col, "sentence_index", F.col("s.sentence").alias("sentence"), F.col("s.start").alias("start"),
        (F.col("s.start") + F.char_length("s.sentence")).alias("end"),
    )


def with_tokens(rows: DataFrame) -> DataFrame:
    """Adds ``tokens array<struct<text, lower, start, end>>`` to rows with ``sentence`` and ``sentence_start``."""
    words = F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0))
    between = F.transform(F.split("sentence", TOKEN, -1), F.char_length)  # one more than there are tokens
    rows = computed_once(rows, "words", words)
    rows = computed_once(rows, "starts", running_starts(F.col("words"), F.slice(between, F.lit(1), F.size("words")), F.col("sentence_start")))
    token = lambda w, s: F.struct(w.alias("text"), F.lower(w).alias("lower"), s.alias("start"), (s + F.char_length(w)).alias("end"))
    return computed_once(rows, "tokens", F.zip_with("words", "starts", token)).drop("words", "starts")


def sentence_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sentence_index, sentence, sentence_start, tokens)``: one row per sentence."""
    rows = sentences(documents, id_col, text_col).select(id_col, "sentence_index", "sentence", F.col("start").alias("sentence_start"))
    return with_tokens(rows)


def tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sentence_index, tok, token, lower, start, end)``: one row per token."""
    rows = sentence_tokens(documents, id_col, text_col).select(id_col, "sentence_index", F.posexplode("tokens").alias("tok", "t"))
    return rows.select(id_col, "sentence_index", "tok", F.col("t.text").alias("token"), F.col("t.lower").alias("lower"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))
