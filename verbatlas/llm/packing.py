"""Texts put into containers of fixed capacity by harmonic packing (problem 8).

A length s belongs to the reciprocal-capacity class j = floor(capacity / s): at least j texts of this class fill a
container. All pieces of texts are spread by hash over shares of about ``SHARE`` pieces, and every worker packs its
shares on its own:

1. Harmonic step: the classes follow one another from the largest lengths on, and what is left of class j opens
   containers of exactly j pieces each (the last one of a share may hold fewer).
2. Complementary step, before a class opens containers of its own: its pieces go into the room that containers of
   larger classes leave, each into the smallest room that takes it.

Containers of all shares are then numbered through by a prefix sum over the shares. No length histogram, plan or list
of containers ever reaches the driver; only ids and lengths are shuffled, never texts. A length that a third of all
texts have is spread over all shares like any other.

Defined results: null and empty texts have no tokens and stand in no container; a text longer than the
capacity is cut into pieces of the capacity and a rest, any other text is never cut; capacities that are
null or below 1 are left out; a null kind of container or a null id is kept as such; rows delivered twice are packed
each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.llm.bpe import TOKENIZERS, count_tokens
from verbatlas.session import drop_materialized, materialize, parameter_rows, ship

#: Pieces that one share holds on average.
SHARE = 50_000


def fill_rooms(room: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The container of each piece (-1: none takes it) and the rooms afterwards.

    ``lengths`` descend. Each piece takes the smallest room of at least its length; of equal rooms the first.
    """
    placed = np.full(len(lengths), -1, np.int64)
    order = np.argsort(room, kind="stable")
    stacks: dict[int, list[np.ndarray]] = {}
    values, begin = np.unique(room[order], return_index=True)
    for value, members in zip(values.tolist(), np.split(order, begin[1:])):
        if value:
            stacks[value] = [members]
    room = room.copy()
    cuts = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1])) if len(lengths) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lengths)]):
        length = int(lengths[a])
        while a < b:
            fitting = [r for r in stacks if r >= length]
            if not fitting:
                break
            for value in sorted(fitting):
                members = np.concatenate(stacks.pop(value))
                take, rest = members[: b - a], members[b - a :]
                placed[a : a + len(take)] = take
                room[take] = value - length
                a += len(take)
                if len(rest):
                    stacks[value] = [rest]
                if value > length:
                    stacks.setdefault(value - length, []).append(take)
                if a == b:
                    break
    return placed, room


def pack_share(lengths: np.ndarray, capacity: int, complementary: bool = True) -> np.ndarray:
    """The container, from 0, of each piece of one share."""
    order = np.argsort(-lengths, kind="stable")
    descending = lengths[order]
    classes = capacity // descending
    container = np.empty(len(lengths), np.int64)
    room = np.zeros(0, np.int64)
    begin = np.flatnonzero(np.append(True, classes[1:] != classes[:-1])) if len(lengths) else np.zeros(0, np.int64)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(lengths)]):
        at, of_class, count = order[a:b], descending[a:b], int(classes[a])
        if complementary and len(room):
            placed, room = fill_rooms(room, of_class)
            container[at[placed >= 0]] = placed[placed >= 0]
            at, of_class = at[placed < 0], of_class[placed < 0]
        number = np.arange(len(at)) // count
        container[at] = len(room) + number
        room = np.append(room, capacity - np.bincount(number, weights=of_class).astype(np.int64))
    return container


def pieces_of(counted: DataFrame, kinds: list[tuple[str | None, int]]) -> DataFrame:
    """``(kind, id, row, piece, token_start, token_end)``; ``kind`` is the place of the container kind in ``kinds``."""
    each = []
    for kind, (_, capacity) in enumerate(kinds):
        cut = counted.select("id", "row", "n_tokens", F.explode(F.sequence(F.lit(0), F.expr(f"(n_tokens - 1) div {capacity}").cast("int"))).alias("piece"))
        start = F.col("piece") * F.lit(capacity)
        each.append(cut.select(F.lit(kind).alias("kind"), "id", "row", "piece", start.alias("token_start"), F.least(start + capacity, F.col("n_tokens")).alias("token_end")))
    return reduce(DataFrame.unionByName, each)


def pack_shares(items: DataFrame, capacities: list[int]) -> DataFrame:
    """Adds ``local``, the number of the container inside its share; a share is all rows of a ``(kind, share)``."""
    ship(items.sparkSession)
    names = [*items.columns, "local"]

    def packed(share: pa.Table) -> Iterator[pa.RecordBatch]:
        lengths = share.column("token_end").to_numpy().astype(np.int64) - share.column("token_start").to_numpy()
        local = pack_share(lengths, capacities[share.column("kind")[0].as_py()])
        yield from share.append_column("local", pa.array(local)).combine_chunks().to_batches(max_chunksize=10_000)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            kind, share = (batch.column(names.index(n)).to_numpy() for n in ("kind", "share"))
            cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (share[1:] != share[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if held and key != (kind[a], share[a]):
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                key = (kind[a], share[a])
        if held:
            yield from packed(pa.Table.from_batches(held))

    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = items.repartition(parts, "kind", "share").sortWithinPartitions("kind", "share", "row", "piece")
    fields = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)
    return ordered.mapInArrow(kernel, f"{fields}, local long")


def pack(
    documents: DataFrame,
    limits: DataFrame,
    vocabulary: str = "byte_bpe_50k",
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """``(container_kind, container_id, doc_id, piece, token_start, token_end)`` of every piece of every text
    for each capacity of ``limits(container_kind, capacity)``, a parameter table of a few rows."""
    spark = documents.sparkSession
    kinds = [(r.container_kind, int(r.capacity)) for r in parameter_rows(limits.where("capacity >= 1").select("container_kind", "capacity").distinct().orderBy("container_kind", "capacity"), 100)]
    counted = count_tokens(documents, vocabulary, id_col, text_col, tokenizers)
    counted = materialize(counted.select(F.col(id_col).alias("id"), "n_tokens").where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id()), "token-counts")
    pieces = pieces_of(counted if kinds else counted.where(F.lit(False)), kinds or [(None, 1)])
    kinds = kinds or [(None, 1)]
    sums = counted.agg(*(F.sum(F.expr(f"(n_tokens + {c - 1}) div {c}")).alias(f"n{i}") for i, (_, c) in enumerate(kinds))).first()
    shares = [max(1, -(-(n or 0) // SHARE)) for n in sums]
    salt = F.pmod(F.xxhash64("row", "piece"), F.element_at(F.array(*map(F.lit, shares)), F.col("kind") + 1))
    packed = materialize(pack_shares(pieces.withColumn("share", salt.cast("int")), [c for _, c in kinds]), "packed-shares")
    drop_materialized(counted)
    # one row for each share: a prefix sum numbers the containers through
    before = Window.partitionBy("kind").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    used = packed.groupBy("kind", "share").agg((F.max("local") + 1).alias("n"))
    first = used.select("kind", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    name = F.element_at(F.array(*(F.lit(k).cast("string") for k, _ in kinds)), F.col("kind") + 1)
    return packed.join(first, ["kind", "share"]).select(
        name.alias("container_kind"), (F.col("first") + F.col("local")).alias("container_id"), F.col("id").alias(id_col), "piece", "token_start", "token_end"
    )


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per kind: containers, pieces, tokens, the share of the capacity that is used, and how many containers the
    harmonic step would need alone (in one share)."""
    size = F.col("token_end") - F.col("token_start")
    bounds = limits.where("capacity >= 1").select("container_kind", "capacity").distinct()
    per = packed.join(F.broadcast(bounds), packed["container_kind"].eqNullSafe(bounds["container_kind"])).select(  # a parameter table
        bounds["container_kind"], "capacity", "container_id", size.alias("size"), F.expr("capacity div (token_end - token_start)").alias("class")
    )
    classes = per.groupBy("container_kind", "capacity", "class").agg(
        F.count("*").alias("n"), F.sum("size").alias("tokens"), (F.max("container_id") + 1).alias("containers")
    )
    return classes.groupBy("container_kind", "capacity").agg(
        F.max("containers").alias("containers"), F.sum("n").alias("pieces"), F.sum("tokens").alias("tokens"),
        F.sum(F.ceil(F.col("n") / F.col("class"))).cast("long").alias("harmonic_containers"),
    ).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
