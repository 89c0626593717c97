"""Word-level examples: validation, splits and long form.

An example is valid if its ids are not blank, it has words and none of them is null or empty, there are as many
tags as words, the tags are strict BIO, exactly one of them is ``B-V`` and it stands at the predicate index, and
the roleset is not blank. The first reason that applies is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.operators.bio import malformed_at, orphan_at

SPLITS = ("train", "development", "test")


def blank(column: str) -> Column:
    return ~F.coalesce(F.col(column), F.lit("")).rlike(r"[^\p{Z}\t\n\x0B\f\r\x1c-\x1f\x85]")


def example_error(with_split: bool = False) -> Column:
    """The first reason why a row is no valid example, null if it is one."""
    index, words, tags = F.col("predicate_index"), F.col("words"), F.col("tags")
    checks = [
        (~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), "split_invalid")] if with_split else []
    checks += [
        (blank("example_id"), "example_id_empty"),
        (blank("document_id"), "document_id_empty"),
        (blank("sentence_id"), "sentence_id_empty"),
        (words.isNull() | (F.size(words) <= 0), "words_empty"),
        (F.exists(words, lambda w: w.isNull() | (w == "")), "word_empty"),
        (index.isNull() | (index < 0) | (index >= F.size(words)), "predicate_index_out_of_range"),
        (tags.isNull() | (F.size(tags) != F.size(words)), "length_mismatch"),
        (malformed_at(tags).isNotNull(), "tag_invalid"),
        (orphan_at(tags).isNotNull(), "transition_invalid"),
        (F.coalesce(F.try_element_at(tags, index + 1), F.lit("")) != "B-V", "predicate_tag_missing"),
        (F.size(F.filter(tags, lambda t: t == "B-V")) != 1, "predicate_tag_count_invalid"),
        (blank("predicate_roleset"), "roleset_empty"),
    ]
    return F.coalesce(*(F.when(condition, F.lit(reason)) for condition, reason in checks))


def validated(examples: DataFrame, with_split: bool = False) -> DataFrame:
    """Adds ``reason_code`` to every row."""
    return examples.withColumn("reason_code", example_error(with_split))


def with_splits(prepared: DataFrame, manifest: DataFrame) -> DataFrame:
    """Prepared examples with the split of their document; the manifest is ``(document_id, split)``.

    Documents without an entry, or with a value that is no split, get ``split_error`` set and a null split.
    """
    wanted = manifest.select("document_id", F.col("split").alias("_split"))
    joined = prepared.join(wanted, "document_id", "left")
    valid = F.col("_split").isin(*SPLITS)
    return joined.withColumn("split", F.when(valid, F.col("_split"))).withColumn(
        "split_error", F.when(~F.coalesce(valid, F.lit(False)), "split_invalid")
    ).drop("_split")


def tags_long(examples: DataFrame, *keys: str) -> DataFrame:
    """One row per word: the keys, ``pos``, ``word``, ``tag``."""
    zipped = F.arrays_zip("words", "tags")
    return examples.select(*keys, F.posexplode(zipped).alias("pos", "z")).select(*keys, "pos", F.col("z.words").alias("word"), F.col("z.tags").alias("tag"))
