"""BIO tags: splitting, repair, strict and lenient decoding, continuation tags.

All of it works on the tag array of one row, without a shuffle. Repair needs only the original label before a
tag (it changes prefixes, never labels), and a span ends where the next tag is no ``I`` of it, so both are
expressions over neighbouring positions.

Defined results: a null or empty array has no spans; null elements and tags that are neither ``O`` nor ``B-x`` or
``I-x`` are malformed; a row with a malformed tag has ``error`` set and no spans; repeated rows are decoded each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.operators.text import computed_once

#: A well-formed tag; roles may hold hyphens.
WELL_FORMED = r"^(?:O|[BI]-(?s:.+))$"


def prefix_of(tag: Column) -> Column:
    return F.substring(tag, 1, 1)


def label_of(tag: Column) -> Column:
    """The role of a tag; empty for ``O``."""
    return F.when(tag == "O", "").otherwise(F.substring(tag, F.lit(3), F.char_length(tag)))


def malformed_at(tags: Column) -> Column:
    """The first position with a malformed tag, null if there is none."""
    bad = F.transform(tags, lambda t, i: F.when(~F.coalesce(t.rlike(WELL_FORMED), F.lit(False)), i))
    return F.array_min(bad)


def before(tags: Column, i: Column) -> Column:
    """The tag before position ``i``; ``O`` at the start."""
    return F.when(i > 0, F.try_element_at(tags, i)).otherwise(F.lit("O"))


def is_orphan(tag: Column, previous: Column) -> Column:
    """An ``I`` tag that does not follow a tag of the same role."""
    return (prefix_of(tag) == "I") & ~((prefix_of(previous) != "O") & (label_of(previous) == label_of(tag)))


def orphan_at(tags: Column) -> Column:
    """The first position with an orphaned ``I`` tag, null if there is none."""
    return F.array_min(F.transform(tags, lambda t, i: F.when(is_orphan(t, before(tags, i)), i)))


def repair(tags: Column) -> Column:
    """Orphaned ``I`` tags become ``B`` tags."""
    return F.transform(tags, lambda t, i: F.when(is_orphan(t, before(tags, i)), F.concat(F.lit("B-"), label_of(t))).otherwise(t))


def continuation(tag: Column) -> Column:
    """The tag of a further piece of the same word."""
    return F.when(tag == "O", tag).otherwise(F.concat(F.lit("I-"), label_of(tag)))


def decode(tags: Column) -> Column:
    """``array<struct<label, start, end>>`` of tags without orphans: each span is a ``B`` and the ``I`` behind it.

    The prefixes of all tags are bound once as one string, in which a span is a short regular expression.
    """
    prefixes = F.array_join(F.transform(tags, prefix_of), "")

    def spans(letters: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.char_length(letters)), lambda i: F.substring(letters, i + 1, F.lit(1)) == "B")
        size = lambda i: F.char_length(F.regexp_extract(F.substring(letters, i + 1, F.char_length(letters)), "^BI*", 0))
        return F.transform(
            starts,
            lambda i: F.struct(label_of(F.element_at(tags, i + 1)).alias("label"), i.cast("int").alias("start"), (i + size(i)).cast("int").alias("end")),
        )

    return F.element_at(F.transform(F.array(prefixes), spans), 1)


def decoded(df: DataFrame, tags_col: str = "tags", repair_tags: bool = True) -> DataFrame:
    """Adds ``spans``, ``repaired`` (number of changed tags) and ``error`` to the rows of ``df``.

    With ``repair_tags`` false an orphaned ``I`` tag is an error that names its position, as a malformed tag
    always is.
    """
    tags = F.col(tags_col)
    checked = computed_once(computed_once(df, "_bad", malformed_at(tags)), "_orphan", orphan_at(tags))
    error = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("invalid BIO tag at word "), F.col("_bad").cast("string")))
    if not repair_tags:
        error = error.when(F.col("_orphan").isNotNull(), F.concat(F.lit("invalid I-tag transition at word "), F.col("_orphan").cast("string")))
    good = F.when(F.col("_bad").isNull(), repair(tags) if repair_tags else tags)
    changed = F.size(F.filter(F.zip_with(tags, F.col("_good"), lambda a, b: a != b), lambda x: x)) if repair_tags else F.lit(0)
    rows = computed_once(checked.withColumn("error", error), "_good", F.when(F.col("error").isNull(), good))
    return (
        rows.withColumn("spans", F.coalesce(decode(F.col("_good")), F.array().cast("array<struct<label:string,start:int,end:int>>")))
        .withColumn("repaired", F.when(F.col("_good").isNotNull(), changed).otherwise(0))
        .drop("_bad", "_orphan", "_good")
    )


def in_order(spans: Column) -> Column:
    """Spans in their order: by label, start and end."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"))))


def spans_long(decoded_rows: DataFrame, *keys: str) -> DataFrame:
    """One row per span: the keys, ``label``, ``start``, ``end``."""
    return decoded_rows.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.label", "s.start", "s.end")
