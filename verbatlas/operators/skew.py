"""Per-key results that no heavy key holds up, by value-frequency compression (problem 2).

Rows are first grouped by key *and* value, with partial aggregation before the shuffle, so a key with a third
of all rows arrives as one row per distinct value, from all tasks alike. Counts, exact distinct counts and
modes follow from these weighted values by aggregates that combine before their shuffle too. Exact percentiles
need the values of a key in order: weighted values are range-partitioned by key *and* value, so a key is cut into as
many ranges as its number of distinct values needs, by its own values. A prefix sum over the ranges of a key (at most
one for each partition) finds the range that holds the rank, and only that range is put in order.
So no task ever holds all rows, or all distinct values, of one key.

Defined results: rows with a null key are left out (their share still counts in shares of all rows); null
values are not counted as values, though their rows count; of equally frequent values the smallest is the
mode; percentile p is the smallest value with at least p of the key's values at or below it; a key without
values has null mode and percentiles; an empty table gives no keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.session import materialize


def compress(df: DataFrame, key: str, value: Column | str) -> DataFrame:
    """``(key, value, weight)``: the rows of each key and value, counted."""
    value = F.col(value) if isinstance(value, str) else value
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count("*").alias("weight"))


def key_totals(weighted: DataFrame) -> DataFrame:
    """``(key, rows)`` from weighted values."""
    return weighted.groupBy("key").agg(F.sum("weight").alias("rows"))


def distinct_and_mode(weighted: DataFrame) -> DataFrame:
    """``(key, rows, distinct, mode)`` from weighted values."""
    valued = F.col("value").isNotNull()
    return weighted.groupBy("key").agg(
        F.sum("weight").alias("rows"),
        F.count("value").alias("distinct"),
        F.min(F.when(valued, F.struct((-F.col("weight")).alias("weight"), "value")))["value"].alias("mode"),
    )


def percentiles(weighted: DataFrame, points: Mapping[str, float], ranges: int | None = None) -> DataFrame:
    """``(key, <name>...)``: exact percentiles of numeric values, one column per entry of ``points``.

    ``ranges`` is the number of partitions, by default that of shuffles. They are written once, as their borders come from a
    sample and must not change between the uses.
    """
    parts = ranges or int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = weighted.where(F.col("value").isNotNull()).repartitionByRange(parts, "key", "value")
    ranged = materialize(valued.withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("key", "range").agg(F.sum("weight").alias("in_range"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    placed = sums.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0))).withColumn("all", F.sum("in_range").over(whole))
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in points.items())))
    targets = placed.select("key", "range", "before", "in_range", "all", wanted.alias("w")).withColumn(
        "rank", F.greatest(F.lit(1), F.ceil(F.col("w.p") * F.col("all") - F.lit(1e-9)))
    )
    targets = targets.where("rank > before and rank <= before + in_range").select("key", "range", "before", "rank", F.col("w.name").alias("name"))
    inside = Window.partitionBy("key", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.join(targets.select("key", "range").distinct(), ["key", "range"], "left_semi").withColumn("upto", F.sum("weight").over(inside))
    hit = running.join(targets, ["key", "range"]).where("before + upto >= rank and before + upto - weight < rank")
    return hit.groupBy("key").agg(*(F.min(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in points))


def profile(df: DataFrame, key: str, category: str, measure: Column, points: Mapping[str, float]) -> DataFrame:
    """``(key, rows, distinct, mode, <percentiles>)``: the distinct values and mode of ``category`` and the
    percentiles of ``measure`` for every key."""
    counted = distinct_and_mode(compress(df, key, category))
    ranked = percentiles(compress(df, key, measure), points)
    return counted.join(ranked, "key", "left")


def heavy_keys(df: DataFrame, fields: Sequence[str], share: float) -> DataFrame:
    """``(key_field, key_value)``: values that stand in at least ``share`` of all rows.

    The fields are compressed together: one shuffle of their distinct combinations serves all of them.
    """
    combined = df.groupBy(*fields).agg(F.count("*").alias("weight"))
    every = df.agg(F.count("*").alias("n")).scalar()
    each = [combined.select(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key"), "weight") for f in fields]
    weighted = reduce(DataFrame.unionByName, each).where(F.col("key").isNotNull())
    totals = weighted.groupBy("key_field", "key").agg(F.sum("weight").alias("rows"))
    return totals.where(F.col("rows") >= F.lit(share) * every).select("key_field", F.col("key").alias("key_value"))
