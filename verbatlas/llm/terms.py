"""Occurrences and records of every distinct term, with rare and common ones marked (problem 4).

Every record gives its distinct terms with the number of times they stand in it, so repeats inside a record never
leave the scan. These tokens are hash-partitioned by field, term and a salt of the record, and put in order of term and
record. One counter at a time then runs over a partition: it keeps the occurrences, the records and the last record
met, so no set of records and no vocabulary is ever held, and a record delivered several times is the record
just seen. The counters of the salts are added. A term that stands in most records (such as the tag of words outside
all roles) is spread over as many salts as there are shuffle partitions. All records are counted by a token of their own.

Defined results: null terms, null arrays and records without identifier are not counted; an empty string
is a term; terms compare exactly as stored; a record delivered several times counts once for every term that any of its
deliveries holds, with the occurrences of the first one that does (by ingestion time); a record with neither field
present still counts as a record.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.operators.text import computed_once
from verbatlas.session import materialize, ship

RARE_RECORDS, COMMON_SHARE = 3, 0.25

#: The field of the tokens that count records.
ALL = ""


TOKENS = "array<struct<field:string,term:string,times:int>>"


def runs_of(ordered: str, begins: str, field: str) -> Column:
    """The tokens of a sorted array of terms, from the places at which a new term begins."""

    def token(place: Column, number: Column) -> Column:
        behind = F.coalesce(F.try_element_at(F.col(begins), number + 2), F.array_size(ordered) + 1)
        return F.struct(F.lit(field).alias("field"), F.element_at(ordered, place).alias("term"), (behind - place).alias("times"))

    return F.coalesce(F.transform(begins, token), F.array().cast(TOKENS))


def tokens(examples: DataFrame, fields: Sequence[str], id_col: str, order_col: str) -> DataFrame:
    """``(field, term, record, at, times)``: the distinct terms of every row with the times they stand in it."""
    types = dict(examples.dtypes)
    arrays = [(F.col(f) if types[f].startswith("array") else F.array(f)).alias(f"f{i}") for i, f in enumerate(fields)]
    rows = examples.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("record"), F.col(order_col).alias("at"), *arrays)
    each = [F.array(F.struct(F.lit(ALL).alias("field"), F.lit("").alias("term"), F.lit(1).alias("times")))]
    for i, field in enumerate(fields):
        ordered, begins = f"s{i}", f"b{i}"
        rows = computed_once(rows, ordered, F.array_sort(F.filter(f"f{i}", lambda t: t.isNotNull())))
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(ordered, F.lit(1), F.greatest(F.array_size(ordered) - 1, F.lit(0))))
        new = F.transform(F.arrays_zip(F.col(ordered).alias("a"), before.alias("b")), lambda x, k: F.when(~x["a"].eqNullSafe(x["b"]), k + 1))
        rows = computed_once(rows, begins, F.when(F.array_size(ordered) > 0, F.filter(new, lambda k: k.isNotNull())))
        each.append(runs_of(ordered, begins, field))
    return rows.select("record", "at", F.explode(F.concat(*each)).alias("x")).select("x.field", "x.term", "record", "at", "x.times")


def count_in_order(ordered: DataFrame) -> DataFrame:
    """Last-seen counters of tokens in order of field, term and record: ``(field, term, occurrences, records)``, to
    be added where a term has several rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, str, str] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            field, term, record = batch.columns[:3]
            other = lambda x: np.asarray(pc.not_equal(x[1:], x[:-1]))
            new_term = np.append(True, other(field) | other(term))
            same = last is not None and last[:2] == (field[0].as_py(), term[0].as_py())
            fresh = np.append(not (same and last[2] == record[0].as_py()), new_term[1:] | other(record))
            last = (field[-1].as_py(), term[-1].as_py(), record[-1].as_py())
            first = np.flatnonzero(new_term)
            occurrences = np.add.reduceat(np.where(fresh, batch.column(3).to_numpy(), 0).astype(np.int64), first)
            records = np.add.reduceat(fresh.astype(np.int64), first)
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([field.take(at), term.take(at), pa.array(occurrences), pa.array(records)], ["field", "term", "occurrences", "records"])

    ship(ordered.sparkSession)
    return ordered.select("field", "term", "record", "times").mapInArrow(kernel, "field string, term string, occurrences long, records long")


def term_frequencies(
    examples: DataFrame,
    fields: Sequence[str] = ("tags", "predicate_roleset"),
    id_col: str = "example_id",
    order_col: str = "ingested_at",
    rare_records: int = RARE_RECORDS,
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """``(term_field, term, occurrences, records, mark)`` of every distinct term; ``mark`` is ``rare`` for
    terms in at most ``rare_records`` records, ``common`` for terms in more than ``common_share`` of all
    records, else null."""
    parts = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = tokens(examples, fields, id_col, order_col).withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(parts)).cast("int"))
    ordered = salted.repartition(parts, "field", "term", "salt").sortWithinPartitions("field", "term", "record", "at")
    counted = count_in_order(ordered).groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    counted = materialize(counted, "terms")  # read twice: the terms, and the one row with all records
    every = counted.where(F.col("field") == ALL).select("records").scalar()
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(common_share) * every, "common")
    return counted.where(F.col("field") != ALL).select(F.col("field").alias("term_field"), "term", "occurrences", "records", mark.alias("mark"))
