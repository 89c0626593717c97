"""Splits that keep related documents together, by grouped iterative stratification (problem 6).

1. Components. Documents and the values that tie them (sentence, author) form a two-sided graph, never
   pairs of documents. Each round hooks every node to the smallest node of its values, follows the hooks a
   few steps and contracts; values with one node left drop out. The edges shrink each round and lie in a
   written table. A value shared by a third of all documents is aggregated, with partial aggregation.
2. Label vectors. Rows are counted per component and label (the roleset).
3. Placement by iterative stratification: the label with the fewest outstanding rows comes first; its components
   go, the richest in it first, each into the split that needs the label most (then rows; a split that has all its
   rows needs nothing), and take all their other labels along, so that the next rarest label is found among what is
   outstanding then.

Placement runs in blocks, each an independent task. The components that are a ``HEAVY``-th of all rows or more (at most
``HEAVY`` can be) are one block and come first, against the needs of the whole collection. What they
leave is needed of the others, which are spread by hash over blocks of about ``BLOCK`` components; every block gets
its part of each label's needs from a running sum over the blocks: what is wanted up to its end less the whole rows that
the splits have before it. So the parts add up, and a label that is rare inside blocks still meets its proportions.

Defined results: rows with null document are left out; null or blank authors and null sentences tie
nothing; other values tie exactly as stored; a null roleset is a label of its own; a row delivered twice
counts once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.session import drop_materialized, materialize, parameter_rows, ship

HEAVY, BLOCK, JUMPS = 200, 5_000, 3


def tying_values(rows: DataFrame, doc_col: str, keys: Sequence[str]) -> DataFrame:
    """``(node, value)``: distinct document and tying value, each kind of value apart from the others."""
    present = rows.where(F.col(doc_col).isNotNull())
    values = F.array(*(F.when(F.col(k).rlike(r"[^\s\p{Z}]"), F.concat(F.lit(f"{i}:"), F.col(k))) for i, k in enumerate(keys)))
    return present.select(F.col(doc_col).alias("node"), F.explode(values).alias("value")).where("value is not null").distinct()


def components(rows: DataFrame, doc_col: str = "document_id", keys: Sequence[str] = ("sentence_id", "author_id")) -> DataFrame:
    """``(node, group)`` of the documents tied to another one; ``group`` is the smallest document so tied."""
    edges = materialize(tying_values(rows, doc_col, keys), "ties")
    groups = None
    while True:
        values = edges.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").drop("high")
        hooked = edges.join(values, "value")
        first = materialize(hooked.groupBy("node").agg(F.min("low").alias("low")), "hooks")
        if first.isEmpty():
            break
        further = first.select(F.col("node").alias("low"), F.col("low").alias("lower"))  # as written
        hooks = first
        for _ in range(JUMPS):  # follow the hooks
            hooks = hooks.join(further, "low").select("node", F.col("lower").alias("low"))
        hooks = materialize(hooks, "hooks")
        tied = hooked.select("node", "value")
        smaller = materialize(tied.join(hooks, "node").select(F.col("low").alias("node"), "value").distinct(), "ties")
        drop_materialized(edges, first)
        edges = smaller
        if groups is None:
            groups = hooks.withColumnRenamed("low", "group")
        else:
            step = hooks.select(F.col("node").alias("group"), "low")
            merged = materialize(groups.join(step, "group", "left").select("node", F.coalesce("low", "group").alias("group")), "groups")
            drop_materialized(groups, hooks)
            groups = merged
    if groups is None:
        return edges.select("node", F.col("node").alias("group")).where(F.lit(False))
    return groups


def stratify(vectors: pd.DataFrame, shares: Sequence[float]) -> list[tuple[str, int]]:
    """``(group, split number)`` of the components of one block, by iterative stratification.

    ``vectors`` has a row ``group, label, n, need_*, rows_*`` for each component and label; ``need_i`` is what split i
    needs of the label, ``rows_i`` what it needs of rows.
    """
    numbers = range(len(shares))
    holds: dict[str, dict[str, int]] = defaultdict(dict)
    of_label: dict[str, list[str]] = defaultdict(list)
    outstanding: dict[str, int] = defaultdict(int)
    need: dict[str, list[float]] = {}
    rows = [float(vectors[f"rows_{i}"].iloc[0]) for i in numbers]
    for group, label, n, *needs in vectors[["group", "label", "n", *(f"need_{i}" for i in numbers)]].itertuples(index=False):
        holds[group][label] = n
        of_label[label].append(group)
        outstanding[label] += n
        need[label] = needs
    size = {group: sum(labels.values()) for group, labels in holds.items()}
    placed: list[tuple[str, int]] = []
    queue = [(n, label) for label, n in outstanding.items()]
    heapq.heapify(queue)
    while queue:
        n, label = heapq.heappop(queue)
        if n != outstanding[label] or not n:
            continue  # counted anew since, or all placed
        touched = set()
        for group in sorted((g for g in of_label[label] if g in holds), key=lambda g: (-holds[g][label], -size[g], g)):
            wants = need[label]
            best = max(numbers, key=lambda i: (rows[i] > 0, wants[i], rows[i], shares[i], -i))
            for other, m in holds.pop(group).items():
                need[other][best] -= m
                outstanding[other] -= m
                touched.add(other)
            rows[best] -= size[group]
            placed.append((group, best))
        for other in touched - {label}:
            heapq.heappush(queue, (outstanding[other], other))
    return placed


def placed_blocks(vectors: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(group, split)`` of vectors with ``block`` and needs; each block is placed by one task."""
    ship(vectors.sparkSession)
    splits, parts = list(shares), list(shares.values())

    def kernel(block: pd.DataFrame) -> pd.DataFrame:
        found = stratify(block, parts)
        return pd.DataFrame({"group": [g for g, _ in found], "split": [splits[i] for _, i in found]}, dtype=object)

    return vectors.groupBy("block").applyInPandas(kernel, "group string, split string")


def assign_splits(
    rows: DataFrame,
    targets: DataFrame,
    doc_col: str = "document_id",
    label_col: str = "predicate_roleset",
    id_col: str = "example_id",
    keys: Sequence[str] = ("sentence_id", "author_id"),
    block: int = BLOCK,
) -> DataFrame:
    """``(document_id, group_id, split)``: one split for every document, the same for all tied documents.

    ``targets`` has a split and its share; it is read to the driver and holds a handful of rows.
    """
    listed = [(r["split"], float(r["share"])) for r in parameter_rows(targets.where("split is not null and share > 0").orderBy("split"), 1000)]
    whole = sum(share for _, share in listed)
    shares = {split: share / whole for split, share in listed}
    numbers = range(len(shares))

    tied = components(rows, doc_col, keys)
    documents = rows.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).alias("node")).distinct()
    member = materialize(
        documents.join(tied, "node", "left").select("node", F.coalesce("group", "node").alias("group")), "membership"
    )
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col)), F.lit("none"))
    counted = rows.where(F.col(doc_col).isNotNull()).select(F.col(doc_col).alias("node"), F.col(id_col).alias("id"), label.alias("label")).distinct()
    vectors = materialize(counted.join(member, "node").groupBy("group", "label").agg(F.count("*").alias("n")), "vectors")
    everything, groups = vectors.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("group")).first()
    sized = vectors.groupBy("group").agg(F.sum("n").alias("size"))
    number = F.when(F.col("size") * HEAVY >= everything, -1).otherwise(F.pmod(F.xxhash64("group"), F.lit(max(1, -(-groups // block)))).cast("int"))
    tagged = materialize(vectors.join(sized.select("group", number.alias("block")), "group"), "block-vectors")
    drop_materialized(vectors)
    heavy, light = tagged.where("block < 0"), tagged.where("block >= 0")

    totals = tagged.groupBy("label").agg(F.sum("n").alias("total"))
    first = heavy.join(totals, "label").select(
        "block", "group", "label", "n", *((F.lit(s) * F.col("total")).alias(f"need_{i}") for i, s in enumerate(shares.values())),
        *(F.lit(float(s * everything)).alias(f"rows_{i}") for i, s in enumerate(shares.values())),
    )
    placed = materialize(placed_blocks(first, shares), "placed")

    done = heavy.join(placed, "group").groupBy("label").agg(*(F.sum(F.when(F.col("split") == s, F.col("n"))).alias(f"done_{i}") for i, s in enumerate(shares)))
    done_rows = done.agg(*(F.coalesce(F.sum(f"done_{i}"), F.lit(0)) for i in numbers)).first()
    left_rows = max(1, everything - sum(done_rows))
    before = Window.partitionBy("label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = light.groupBy("label", "block").agg(F.sum("n").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    light_totals = light.groupBy("label").agg(F.sum("n").alias("light"))
    open_needs = light_totals.join(totals, "label").join(done, "label", "left")
    quota = lambda i, s: (F.lit(s) * F.col("total") - F.coalesce(F.col(f"done_{i}"), F.lit(0))) / F.col("light")
    quotas = open_needs.select("label", *(quota(i, s).alias(f"quota_{i}") for i, s in enumerate(shares.values())))
    # whole rows that the splits have up to the block (by largest remainders); a block needs what is missing at its end
    upto = F.array(*(F.struct((F.col(f"quota_{i}") * F.col("before")).alias("wanted"), F.lit(-i).alias("at")) for i in numbers))
    rest_of = F.transform(upto, lambda x: F.struct((x["wanted"] - F.floor(x["wanted"])).alias("rest"), x["at"].alias("at")))
    over = (F.col("before") - F.aggregate(upto, F.lit(0).cast("long"), lambda n, x: n + F.floor(x["wanted"]))).cast("int")
    rounded_up = F.transform(F.slice(F.sort_array(rest_of, asc=False), F.lit(1), F.greatest(over, F.lit(0))), lambda x: -x["at"])
    had = lambda i: F.floor(F.col(f"quota_{i}") * F.col("before")) + F.array_contains("rounded_up", F.lit(i)).cast("int")
    parts = inside.join(quotas, "label").withColumn("rounded_up", rounded_up).select(
        "label", "block", *((F.col(f"quota_{i}") * (F.col("before") + F.col("here")) - had(i)).alias(f"need_{i}") for i in numbers)
    )
    block_rows = light.groupBy("block").agg(F.sum("n").alias("block_rows"))
    rest = light.join(parts, ["label", "block"]).join(block_rows, "block").select(
        "block", "group", "label", "n", *(f"need_{i}" for i in numbers),
        *((F.lit((s * everything - done_rows[i]) / left_rows) * F.col("block_rows")).alias(f"rows_{i}") for i, s in enumerate(shares.values())),
    )
    placed = placed.unionByName(placed_blocks(rest, shares))
    return member.join(placed, "group").select(F.col("node").alias(doc_col), F.col("group").alias("group_id"), "split")


def split_shares(rows: DataFrame, placed: DataFrame, targets: DataFrame, doc_col: str = "document_id", label_col: str = "predicate_roleset", id_col: str = "example_id") -> DataFrame:
    """``(split, share, rows, row_share, label_gap)``: how the wanted proportions are met; ``label_gap`` is the mean over
    all rows of how far the share of the row's label in the split is from the wanted one."""
    label = F.coalesce(F.concat(F.lit("="), F.col(label_col)), F.lit("none"))
    counted = rows.where(F.col(doc_col).isNotNull()).select(doc_col, id_col, label.alias("label")).distinct().join(placed, doc_col).groupBy("label", "split").agg(F.count("*").alias("n"))
    counted = materialize(counted, "split-labels")
    totals = counted.groupBy("label").agg(F.sum("n").alias("total"))
    every = counted.agg(F.sum("n")).scalar()
    wanted = targets.where("split is not null and share > 0")
    norm = wanted.agg(F.sum("share")).scalar()
    # labels x splits: the splits are a parameter table of a few rows
    each = totals.withColumn("t", F.lit(1)).join(F.broadcast(wanted.select("split", (F.col("share") / norm).alias("share"), F.lit(1).alias("t"))), "t").drop("t")
    joined = each.join(counted, ["label", "split"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.groupBy("split", "share").agg(
        F.sum("n").alias("rows"), (F.sum("n") / every).alias("row_share"), (F.sum(F.abs(F.col("n") - F.col("share") * F.col("total"))) / every).alias("label_gap")
    )


def one_split_per_document(examples: DataFrame, order: Sequence[str] = ("train", "development", "test")) -> DataFrame:
    """``(document_id, split, examples, moved)``: the split that holds most of a document's examples (the
    earlier of ``order`` among equals), and how many examples come from another or from no split.

    Documents whose examples have no split at all keep a null split.
    """
    rows = examples.where("document_id is not null and example_id is not null").select("document_id", "example_id", "split").distinct()
    counted = rows.groupBy("document_id", "split").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("split"))
    rank = F.when(rank > 0, rank).otherwise(len(order) + 1)
    best = F.max_by("split", F.when(F.col("split").isNotNull(), F.struct(F.col("n"), -rank, F.col("split"))))
    return counted.groupBy("document_id").agg(
        best.alias("split"),
        F.sum("n").alias("examples"),
        (F.sum("n") - F.coalesce(F.max(F.when(F.col("split").isNotNull(), F.col("n"))), F.lit(0))).alias("moved"),
    )
