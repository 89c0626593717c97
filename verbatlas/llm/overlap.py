"""Same and near-same examples across splits, by an edit-distance segment join (problem 3).

An example is the sequence of its distinct lower-cased words in one order for the whole collection (the common
words last). For such sequences the insertions and deletions between two of them are exactly the words that only
one has, so a share ``threshold`` of common words is a bound on the edit distance.

1. An evaluation sequence of n words that may be k edits away is cut into k + 1 segments: single words at its rare
   end, then pairs of words, and as last segment all that is left. Edits before a segment and behind it are counted:
   some segment i survives with exactly i edits before it and at most k - i behind it.
2. So segment i may stand in a training sequence only at the positions that i insertions and deletions can shift it
   to (i, i - 2, ... to either side), and only where the rest behind it can be made equal with the edits that are
   left. Training sequences give the hashes of exactly these substrings, and a hash join on (substring, position)
   finds the candidates. A signature of word parities, which d edits change in at most d bits, drops most chance hits.
3. Candidates are verified by banded dynamic programming over the words themselves.

The order only decides how selective segments are, never what is found; it ranks the ``RANKED`` most frequent words,
a table of that bound, and puts all others first. Equal sequences are one class (by SHA-256 of their JSON text) and
travel once; a membership table keeps their examples, so copies make no pairs before the result.

Defined results: null words are not words; examples without words, without id or without split make no
pair; an id delivered twice makes each pair once; a pair of an id with itself is left out. Thresholds below 0.6 are an
error: their edits can outnumber the words that would be cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.session import materialize, ship

THRESHOLD = 0.75
TRAIN, EVALUATION = ("train",), ("development", "test")

#: Words that are ranked by their frequency.
RANKED = 20_000

#: Odd multipliers of the hash of a substring and of its position.
STEP, PLACE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

BACK = pow(STEP, -1, 1 << 64)

#: Keys that are made at once.
CELLS = 1 << 20

NEAR = 1e-9


def members(examples: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``(digest, words, example_id, side, split, ...)`` of all examples that can make a pair."""
    words = F.array_sort(F.array_distinct(F.transform(F.filter("words", lambda w: w.isNotNull()), F.lower)))
    side = F.when(F.col("split").isin(*TRAIN), "t").when(F.col("split").isin(*EVALUATION), "e")
    rows = examples.select("example_id", "split", side.alias("side"), words.alias("words"), *extra)
    rows = rows.where(F.col("side").isNotNull() & F.col("example_id").isNotNull() & (F.size("words") > 0))
    return rows.withColumn("digest", F.unhex(F.sha2(F.to_json("words"), 256)))


def edits(threshold: float, words: int) -> int:
    """The most edits between two sequences of together ``words`` words that are near enough."""
    return floor((1 - threshold) / (1 + threshold) * words + NEAR)


@lru_cache(maxsize=4096)
def segments(n: int, threshold: float) -> tuple[int, tuple[tuple[int, int], ...]]:
    """The number k of edits that n words may be away, and ``(start, length)`` of the k + 1 segments."""
    k = edits(threshold, n + floor(n / threshold + NEAR))
    single = (k + 1) // 2 if 2 * k - (k + 1) // 2 < n else k
    starts = [*range(single), *range(single, 2 * k - single, 2), 2 * k - single]
    return k, tuple((a, b - a) for a, b in zip(starts, [*starts[1:], n]))


@lru_cache(maxsize=4096)
def sought(n: int, threshold: float) -> np.ndarray:
    """Rows ``(segment, start, length, position)``: where the segments of n words may stand."""
    k, cuts = segments(n, threshold)
    rows = [(i, p, length, q) for i, (p, length) in enumerate(cuts) for q in range(p - i, p + i + 1, 2) if q >= 0]
    return np.array(rows, np.int64)


@lru_cache(maxsize=4096)
def offered(m: int, threshold: float) -> np.ndarray:
    """Rows ``(length, position)``: the substrings of m words that a segment of a near sequence can equal."""
    marks: dict[int, np.ndarray] = {}
    for n in range(max(1, ceil(threshold * m - NEAR)), floor(m / threshold + NEAR) + 1):
        k, cuts = segments(n, threshold)
        for i, (p, length) in enumerate(cuts):
            behind = min(k, edits(threshold, n + m)) - i
            if behind < 0 or length > m:
                continue
            low, high = max(p - i, p + m - n - behind, 0), min(p + i, p + m - n + behind, m - length)
            low += (low - p - i) % 2
            if low <= high:
                marks.setdefault(length, np.zeros(m + 1, bool))[low : high + 1 : 2] = True
    rows = [(length, q) for length, mark in marks.items() for q in np.flatnonzero(mark)]
    return np.array(rows, np.int64).reshape(-1, 2)


def flat_codes(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a column of lists, the words as numbers of these, and the sizes of the lists."""
    sizes = np.diff(column.offsets.to_numpy())
    coded = column.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), sizes


def sequences(classes: DataFrame) -> DataFrame:
    """``(class, is_eval, is_train, n, seq)``: the words of each class in the order of the collection."""
    ship(classes.sparkSession)
    counted = classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    top = counted.orderBy(F.desc("df"), "word").limit(RANKED).collect()
    rank = {r.word: i for i, r in enumerate(reversed(top), 1)}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            distinct, codes, sizes = flat_codes(column)
            place = [(rank.get(w, 0), w) for w in distinct.to_pylist()]
            order = np.empty(len(place), np.int64)
            order[sorted(range(len(place)), key=place.__getitem__)] = np.arange(len(place))
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.lexsort((order[codes], row))
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            ordered = pa.ListArray.from_arrays(offsets, distinct.take(pa.array(codes[at])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes.astype(np.int32)), ordered], ["class", "is_eval", "is_train", "n", "seq"])

    return classes.select("class", "is_eval", "is_train", "words").mapInArrow(kernel, "class long, is_eval boolean, is_train boolean, n int, seq array<string>")


def substrings(rows: DataFrame, threshold: float, evaluation: bool) -> DataFrame:
    """``(key, class, n, position, segment, start, parity)`` of the segments of evaluation sequences at all allowed
    positions, or of the substrings that training sequences offer. ``key`` hashes substring and position."""
    ship(rows.sparkSession)
    names = ["key", "class", "n", "position", "segment", "start", "parity"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct, codes, sizes = flat_codes(batch.column(1))
            hashed = pd.util.hash_array(np.array(distinct.to_pylist(), object), categorize=False)
            bit = np.uint64(1) << (hashed & np.uint64(63))
            begin = np.cumsum(sizes) - sizes
            ids = batch.column(0).to_numpy()
            for n in np.unique(sizes).tolist():
                plan = sought(n, threshold) if evaluation else offered(n, threshold)
                if not len(plan):
                    continue
                if evaluation:
                    segment, start, length, position = plan.T
                    begins = start
                else:
                    length, position = plan.T
                    segment = start = np.zeros(len(plan), np.int64)
                    begins = position
                power = np.cumprod(np.append(np.uint64(1), np.full(n, STEP, np.uint64)), dtype=np.uint64)
                down = np.array([pow(BACK, b, 1 << 64) for b in begins.tolist()], np.uint64)
                place = (position * 64 + length).astype(np.uint64) * np.uint64(STEP)
                same = np.flatnonzero(sizes == n)
                for which in np.array_split(same, -(-len(same) * len(plan) // CELLS)):
                    table = codes[begin[which][:, None] + np.arange(n)]
                    parity = np.bitwise_xor.reduce(bit[table], axis=1).view(np.int64)
                    sums = np.zeros((len(which), n + 1), np.uint64)
                    np.cumsum(hashed[table] * power[1:], axis=1, out=sums[:, 1:])
                    # the hash of a substring, moved to the same power wherever it stands
                    key = (sums[:, begins + length] - sums[:, begins]) * down
                    key = (key ^ (key >> np.uint64(31))) * np.uint64(PLACE) + place
                    key ^= key >> np.uint64(29)
                    by_plan = lambda values: pa.array(np.tile(values.astype(np.int32), len(which)))  # noqa: B023, E731
                    by_row = lambda values: pa.array(np.repeat(values, len(plan)))  # noqa: B023, E731
                    sizes_of = by_row(np.full(len(which), n, np.int32))
                    columns = [pa.array(key.ravel().view(np.int64)), by_row(ids[which]), sizes_of, by_plan(position), by_plan(segment), by_plan(start), by_row(parity)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "key long, class long, n int, position int, segment int, start int, parity long"
    return rows.select("class", "seq").mapInArrow(kernel, schema)


def candidates(ordered: DataFrame, threshold: float) -> DataFrame:
    """Class pairs ``(ce, ct)`` with a common segment at an allowed position and few enough odd words."""
    left = substrings(ordered.where("is_eval"), threshold, True).select(
        "key", F.col("class").alias("ce"), F.col("n").alias("ne"), (F.col("position") - F.col("start")).alias("shift"), "segment", F.col("parity").alias("pe"))
    right = substrings(ordered.where("is_train"), threshold, False).select("key", F.col("class").alias("ct"), F.col("n").alias("nt"), F.col("parity").alias("pt"))
    most = F.floor(F.lit((1 - threshold) / (1 + threshold)) * (F.col("ne") + F.col("nt")) + NEAR)
    all_edits = F.floor(F.lit((1 - threshold) / (1 + threshold)) * (F.col("ne") + F.floor(F.col("ne") / threshold + NEAR)) + NEAR)
    behind = F.abs(F.col("nt") - F.col("ne") - F.col("shift"))
    lengths = (F.col("nt") >= F.lit(threshold) * F.col("ne") - NEAR) & (F.col("ne") >= F.lit(threshold) * F.col("nt") - NEAR)
    allowed = lengths & (behind + F.col("segment") <= F.least(most, all_edits)) & (F.bit_count(F.col("pe").bitwiseXOR(F.col("pt"))) <= most)
    return left.join(right, "key").where(allowed).select("ce", "ct").distinct()


def banded_distance(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, band: int) -> np.ndarray:
    """Insertions and deletions between rows of ``a`` and ``b`` (padded with different values), all rows
    at once; values beyond ``band`` mean more than ``band``."""
    rows, width = len(a), 2 * band + 1
    far = np.int32(4 * band + 4)
    table = np.full((rows, width + 2), far, np.int32)  # column d + 1 holds cell (i, i + d - band)
    offsets = np.arange(width) - band
    table[:, 1:-1] = np.where(offsets >= 0, offsets, far)
    result = np.where(na == 0, nb, far).astype(np.int32)
    padded = np.full((rows, b.shape[1] + 2 * band + a.shape[1] + 2), -1, b.dtype)
    padded[:, band : band + b.shape[1]] = b
    for i in range(1, a.shape[1] + 1):
        new = np.full_like(table, far)
        for d in range(width):
            j = i + d - band
            if j < 0 or j > b.shape[1]:
                continue
            if j == 0:
                new[:, d + 1] = i
                continue
            same = a[:, i - 1] == padded[:, band + j - 1]
            step = np.minimum(table[:, d + 2], new[:, d]) + 1
            new[:, d + 1] = np.where(same, np.minimum(table[:, d + 1], step), step)
        table = new
        ended = na == i
        if ended.any():
            d = nb[ended] - i + band
            inside = (d >= 0) & (d < width)
            result[ended] = np.where(inside, table[ended, np.clip(d, 0, width - 1) + 1], far)
    return result


def verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """Keep ``(ce, ct, se, st)`` whose sequences are near enough; adds the share of common words.

    Words are compared as such: both columns of a batch are numbered by one dictionary.
    """
    ship(pairs.sparkSession)
    names = ["ce", "ct", "share"]

    def padded(codes: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
        out = np.full((len(sizes), int(sizes.max())), fill, np.int64)
        out[np.arange(out.shape[1]) < sizes[:, None]] = codes
        return out

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.diff(whole.column(2).offsets.to_numpy())
            order = np.argsort(size, kind="stable")  # pairs of like length share a band
            for at in np.array_split(order, max(1, len(order) // 512)):
                if not len(at):
                    continue
                batch = whole.take(pa.array(at))
                both = pa.concat_arrays([batch.column(2), batch.column(3)])
                _, codes, sizes = flat_codes(both)
                na, nb = sizes[: len(at)], sizes[len(at) :]
                a, b = padded(codes[: na.sum()], na, -2), padded(codes[na.sum() :], nb, -3)
                # the distance that the share allows, and so the band
                most = np.floor((1 - threshold) / (1 + threshold) * (na + nb) + NEAR)
                distance = banded_distance(a, b, na, nb, int(most.max()))
                good = distance <= most
                share = (na + nb - distance) / np.maximum(na + nb + distance, 1)
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(share[good])], names
                )

    return pairs.select("ce", "ct", "se", "st").mapInArrow(kernel, "ce long, ct long, share double")


def class_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(ce, ct, share)``: all pairs of an evaluation class and a training class that are near enough."""
    if threshold < 0.6:
        raise ValueError("the threshold must be at least 0.6")
    ordered = materialize(sequences(classes), "sequences")
    found = candidates(ordered, threshold)
    left = ordered.where("is_eval").select(F.col("class").alias("ce"), F.col("seq").alias("se"))
    right = ordered.where("is_train").select(F.col("class").alias("ct"), F.col("seq").alias("st"))
    return verify(found.join(left, "ce").join(right, "ct"), threshold)


def classes_and_members(examples: DataFrame, extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """One row per distinct sequence, numbered, and one row per example without its words."""
    rows = members(examples, extra)
    classes = rows.groupBy("digest").agg(
        F.first("words").alias("words"), F.max(F.col("side") == "e").alias("is_eval"), F.max(F.col("side") == "t").alias("is_train")
    )
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stay
    numbered = rows.drop("words").distinct().join(classes.select("digest", "class"), "digest").drop("digest")
    return classes, materialize(numbered, "members")


def overlapping_pairs(examples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(example_id_a, example_id_b)``, the smaller first: every pair of a training and an evaluation
    example whose sets of words are near enough, once."""
    classes, rows = classes_and_members(examples)
    pairs = class_pairs(classes, threshold)
    ids = rows.select("class", "side", "example_id")
    left = ids.where("side = 'e'").select(F.col("class").alias("ce"), F.col("example_id").alias("e"))
    right = ids.where("side = 't'").select(F.col("class").alias("ct"), F.col("example_id").alias("t"))
    expanded = pairs.join(left, "ce").join(right, "ct").where("e <> t")
    return expanded.select(F.least("e", "t").alias("example_id_a"), F.greatest("e", "t").alias("example_id_b")).distinct()


def overlap_report(examples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per split and source of the evaluation examples: how many there are, how many stand in training
    word for word or changed, and the number of pairs. Counted from classes, without making the pairs."""
    classes, rows = classes_and_members(examples, ["source"])
    pairs = class_pairs(classes, threshold)
    training = rows.where("side = 't'").groupBy("class").agg(F.count_distinct("example_id").alias("n"))
    per_class = (
        pairs.join(training.withColumnRenamed("class", "ct"), "ct")
        .groupBy("ce")
        .agg(F.sum("n").alias("pairs"), F.max((F.col("share") >= 1.0) & (F.col("ce") == F.col("ct"))).alias("exact"))
    )
    joined = rows.where("side = 'e'").dropDuplicates(["class", "example_id"]).join(per_class.withColumnRenamed("ce", "class"), "class", "left")
    return joined.groupBy("split", "source").agg(
        F.count("*").alias("examples"),
        F.count_if(F.col("exact")).alias("exact_examples"),
        F.count_if(~F.col("exact")).alias("changed_examples"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
    )
