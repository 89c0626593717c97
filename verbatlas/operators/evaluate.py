"""Exact labeled-span scores of predicted against gold tags.

Gold is decoded strictly, predictions are repaired first unless told otherwise. Spans of a row are compared as
sets inside the row, so scoring is one scan and one partial aggregate of a few numbers.

Two modes: ``fail`` raises on the first kind of bad row (as a call over sequences would), ``report`` leaves bad
rows out of the sums and :func:`bad_rows` lists them with the reason.

Defined results: an empty table scores 0 everywhere; rows with null tags on either side count as empty sequences;
duplicate rows are scored each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.operators.bio import decoded

EXCLUDED = ("V", "C-V")


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / F.nullif(denominator, F.lit(0)))


def paired(df: DataFrame, gold_col: str, pred_col: str, excluded: Sequence[str], repair_predictions: bool) -> DataFrame:
    """Adds ``gold_spans``, ``pred_spans``, ``repaired`` and ``error``."""
    gold = decoded(df.withColumn("_g", F.coalesce(gold_col, F.array().cast("array<string>"))), "_g", repair_tags=False)
    gold = gold.withColumnsRenamed({"spans": "gold_spans", "error": "gold_error"}).drop("repaired")
    both = decoded(gold.withColumn("_p", F.coalesce(pred_col, F.array().cast("array<string>"))), "_p", repair_tags=repair_predictions)
    both = both.withColumnsRenamed({"spans": "pred_spans", "error": "pred_error"})
    error = F.coalesce(
        F.when(F.size("_g") != F.size("_p"), "gold and prediction lengths differ"),
        F.concat(F.lit("gold: "), F.col("gold_error")),
        F.concat(F.lit("prediction: "), F.col("pred_error")),
    )
    keep = lambda s: ~s["label"].isin(list(excluded))
    filtered = {n: F.array_distinct(F.filter(n, keep) if excluded else F.col(n)) for n in ("gold_spans", "pred_spans")}
    return both.withColumn("error", error).withColumns(filtered).drop("_g", "_p", "gold_error", "pred_error")


def bad_rows(df: DataFrame, key: str, gold_col: str = "gold_tags", pred_col: str = "pred_tags", repair_predictions: bool = True) -> DataFrame:
    """``(key, error)`` of the rows that cannot be scored."""
    return paired(df, gold_col, pred_col, EXCLUDED, repair_predictions).where("error is not null").select(key, "error")


def metrics(tp: Column, predicted: Column, gold: Column) -> list[Column]:
    """The counts with precision, recall and F1; F1 is computed from the two ratios, not from the counts."""
    p, r = ratio(tp, predicted), ratio(tp, gold)
    return [
        tp.alias("true_positives"), predicted.alias("predicted"), gold.alias("gold"), p.alias("precision"), r.alias("recall"),
        F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"),
    ]


def scored(df: DataFrame, gold_col: str, pred_col: str, excluded: Sequence[str], repair_predictions: bool, mode: str) -> DataFrame:
    if mode not in ("fail", "report"):
        raise ValueError("mode must be fail or report")
    rows = paired(df, gold_col, pred_col, excluded, repair_predictions)
    if mode == "fail":
        return rows.withColumn("repaired", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("int")).otherwise(F.col("repaired")))
    return rows.where("error is null")


def score_labeled_spans(
    df: DataFrame,
    gold_col: str = "gold_tags",
    pred_col: str = "pred_tags",
    excluded: Sequence[str] = EXCLUDED,
    repair_predictions: bool = True,
    mode: str = "fail",
) -> DataFrame:
    """One row: ``true_positives, predicted, gold, precision, recall, f1, repaired_prediction_tags``."""
    rows = scored(df, gold_col, pred_col, excluded, repair_predictions, mode)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = rows.agg(
        total(F.size(F.array_intersect("gold_spans", "pred_spans"))).alias("tp"),
        total(F.size("pred_spans")).alias("p"),
        total(F.size("gold_spans")).alias("g"),
        total("repaired").alias("n"),
    )
    return sums.select(*metrics(F.col("tp"), F.col("p"), F.col("g")), F.col("n").alias("repaired_prediction_tags"))


def score_by_role(
    df: DataFrame,
    gold_col: str = "gold_tags",
    pred_col: str = "pred_tags",
    excluded: Sequence[str] = EXCLUDED,
    repair_predictions: bool = True,
    mode: str = "fail",
) -> DataFrame:
    """The same scores per role label."""
    rows = scored(df, gold_col, pred_col, excluded, repair_predictions, mode)
    in_both = F.array_intersect("gold_spans", "pred_spans")
    hits = lambda spans, name: F.transform(spans, lambda s: F.struct(s["label"].alias("label"), *(F.lit(int(name == n)).alias(n) for n in ("tp", "p", "g"))))
    parts = F.concat(hits(in_both, "tp"), hits(F.col("pred_spans"), "p"), hits(F.col("gold_spans"), "g"))
    exploded = rows.select(F.explode(parts).alias("x")).groupBy("x.label").agg(*(F.sum(f"x.{n}").cast("long").alias(n) for n in ("tp", "p", "g")))
    return exploded.select("label", *metrics(F.col("tp"), F.col("p"), F.col("g")))


def token_accuracy(df: DataFrame, gold_col: str = "gold_tags", pred_col: str = "pred_tags") -> DataFrame:
    """One row: ``words, correct, accuracy`` over the positions of rows of equal length."""
    rows = df.where(F.size(gold_col) == F.size(pred_col))
    same = F.size(F.filter(F.zip_with(gold_col, pred_col, lambda a, b: a.eqNullSafe(b)), lambda x: x))
    sums = rows.agg(F.coalesce(F.sum(F.size(gold_col)), F.lit(0)).cast("long").alias("words"), F.coalesce(F.sum(same), F.lit(0)).cast("long").alias("correct"))
    return sums.select("words", "correct", ratio(F.col("correct"), F.col("words")).alias("accuracy"))
