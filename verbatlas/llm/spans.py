"""Long exact spans shared between documents, by super-k-mer partitioning (problem 9).

Every window of ``length`` characters has a minimiser, the smallest hash of the ``word`` characters
long pieces inside it. Consecutive windows with one minimiser form a super-k-mer. Equal windows have
equal minimisers, so

1. one scan cuts all texts into super-k-mers, kept as (minimiser, document, start, windows) without text;
2. an aggregate finds the minimisers that occur in more than one document; all others cannot hold a
   shared window and are dropped before any text is moved;
3. the remaining super-k-mers travel as packed strings, equal strings as one, to the bucket of their
   minimiser, where sorting counts the windows exactly (equal hashes are compared letter by letter);
4. the shared windows go back to their documents and are merged to maximal runs.

A minimiser with more than ``hot`` super-k-mers (boilerplate in many contexts) is split over many
buckets by a second minimiser; copies of a passage are one packed string however often they occur. Where a bucket of
both minimisers still has more than ``hot`` strings, its windows go their own ways: they are spread by the hash of
the whole window, and those whose hash stands in several documents are compared letter by letter. So no task
holds more than ``hot`` strings of one bucket, whatever the texts are, and nothing is dropped.

Packed strings are known by their SHA-256 on the way back to the documents.

Defined results: null texts and texts shorter than ``length`` share nothing; rows with a null id are
left out; rows delivered twice under one id are one document; a passage repeated within one document
only is not shared. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.session import drop_materialized, materialize, ship

#: Length of a shared passage, of the pieces that give minimisers, and of those that split hot buckets.
LENGTH, WORD, SECOND_WORD, HOT = 150, 50, 23, 5_000

#: An odd base of the rolling hash and a multiplier that mixes its bits.
BASE, MIX = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15

CHUNK = 1 << 18


@lru_cache(maxsize=8)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    ups, downs = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    ups[:1] = downs[:1] = 1
    return np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)


def piece_hashes(points: np.ndarray, word: int) -> np.ndarray:
    """A hash of each piece of ``word`` characters, the same wherever the piece stands."""
    size = 1 << max(12, int(len(points)).bit_length())
    ups, downs = (p[: len(points)] for p in powers(size))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * ups, out=sums[1:])
    hashes = (sums[word:] - sums[:-word]) * downs[: len(points) - word + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(MIX)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by doubling."""
    have, low = 1, values
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def window_runs(points: np.ndarray, sizes: np.ndarray, length: int, word: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers of texts that lie one after the other.

    Gives for each the number of its text, its start in the text, its number of windows and its
    minimiser. Every text has at least ``length`` characters.
    """
    low = sliding_minimum(piece_hashes(points, word), length - word + 1)
    ends = np.cumsum(sizes)
    count = sizes - length + 1
    text = np.repeat(np.arange(len(sizes)), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    value = low[np.repeat(ends - sizes, count) + within]
    new = np.flatnonzero((within == 0) | np.append(True, value[1:] != value[:-1]))
    return text[new], within[new], np.diff(np.append(new, len(text))), value[new].view(np.int64)


def _groups_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def super_kmers(documents: DataFrame, id_col: str, text_col: str, length: int, word: int) -> DataFrame:
    """``(mini long, id, start int, windows int)``: all windows of all texts, in one map over the scan."""
    ship(documents.sparkSession)
    id_type = documents.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups_of(texts):
                sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
                text, start, count, value = window_runs(code_points(texts[a:b]), sizes, length, word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value), batch.column(0).take(pa.array(text + a)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["mini", "id", "start", "windows"],
                )

    long_enough = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.col("id").isNotNull() & (F.char_length("text") >= length)
    )
    return long_enough.mapInArrow(kernel, f"mini long, id {id_type}, start int, windows int")


def split_hot(pieces: DataFrame, length: int, second_word: int) -> DataFrame:
    """Give every packed string its bucket; strings of hot minimisers are cut by a second minimiser."""
    id_type = pieces.schema["id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mini", "sub", "id", "start", "packed"]
        for batch in batches:
            hot = batch.column(4).to_numpy(zero_copy_only=False)
            cold = batch.filter(pa.array(~hot))
            if cold.num_rows:
                zero = pa.array(np.zeros(cold.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([cold.column(0), zero, *(cold.column(i) for i in (1, 2, 3))], names)
            rows = batch.filter(pa.array(hot))
            texts = rows.column(3).to_pylist()
            for a, b in _groups_of(texts):
                sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
                text, start, count, value = window_runs(code_points(texts[a:b]), sizes, length, second_word)
                at = pa.array(text + a)
                packed = [texts[a + t][s : s + c + length - 1] for t, s, c in zip(text.tolist(), start.tolist(), count.tolist())]
                first = rows.column(2).take(at).to_numpy(zero_copy_only=False) + start
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(at), pa.array(value), rows.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(packed, pa.string())], names
                )

    return pieces.mapInArrow(kernel, f"mini long, sub long, id {id_type}, start int, packed string")


def shared_windows(texts: list[str], group: np.ndarray, owner: np.ndarray, several: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Which windows of packed strings stand in more than one document.

    ``group`` is the bucket of each string, ``owner`` a number for its document, ``several`` whether
    the string itself stands in several documents. Gives runs of shared windows: the string's number,
    the first window and the number of windows.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = code_points(texts)
    count = sizes - length + 1
    string = np.repeat(np.arange(len(texts)), count)
    within = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(sizes) - sizes, count) + within
    value = piece_hashes(points, length)[begin]
    order = np.lexsort((value, group[string]))
    g, v, p = group[string][order], value[order], begin[order]
    new = np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))
    pair = np.flatnonzero(~new)
    for k in range(0, len(pair), 4096):  # equal hashes must be equal letters
        x, y = p[pair[k : k + 4096]], p[pair[k : k + 4096] - 1]
        reach = np.arange(length)
        if not (points[x[:, None] + reach] == points[y[:, None] + reach]).all():
            content = [points[s : s + length].tobytes() for s in begin.tolist()]
            rank = {c: i for i, c in enumerate(sorted(set(content)))}
            exact = np.fromiter((rank[c] for c in content), np.int64, len(content))
            order = np.lexsort((exact, group[string]))
            g, v = group[string][order], exact[order]
            new = np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))
            break
    first = np.flatnonzero(new)
    who, many = owner[string][order], several[string][order]
    found = (np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)) | np.maximum.reduceat(many, first)
    flag = np.zeros(len(string), bool)
    flag[order] = np.repeat(found, np.diff(np.append(first, len(string))))
    kept = np.flatnonzero(flag)
    if not len(kept):
        return kept, kept, kept
    brk = np.flatnonzero(np.append(True, (np.diff(kept) != 1) | (within[kept[1:]] == 0)))
    return string[kept[brk]], within[kept[brk]], np.diff(np.append(brk, len(kept)))


def count_in_buckets(strings: DataFrame, length: int) -> DataFrame:
    """Shared runs ``(packed_key, first, windows)`` of distinct packed strings, bucket by bucket (of bounded size)."""
    names = ["packed_key", "first", "windows"]

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        mini, sub = rows.column("mini").to_numpy(), rows.column("sub").to_numpy()
        new = np.append(True, (mini[1:] != mini[:-1]) | (sub[1:] != sub[:-1]))
        group = np.cumsum(new) - 1
        several = rows.column("several").to_numpy()
        keep = several | (np.bincount(group)[group] > 1)
        if not keep.any():
            return
        rows, group, several = rows.filter(pa.array(keep)), group[keep], several[keep]
        texts = rows.column("packed").to_pylist()
        owner = rows.column("lo").combine_chunks().dictionary_encode().indices.to_numpy()
        string, first, count = shared_windows(texts, group, owner, several, length)
        at = pa.array(string)
        key = rows.column("packed_key").take(at).combine_chunks()
        yield pa.RecordBatch.from_arrays([key, pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 20_000:
                continue
            mini, sub = held.column("mini").to_numpy(), held.column("sub").to_numpy()
            last = np.flatnonzero((mini != mini[-1]) | (sub != sub[-1]))
            if len(last):  # the last bucket may go on in the next batch
                yield from flush(held.slice(0, int(last[-1]) + 1))
                held = held.slice(int(last[-1]) + 1)
        if held is not None and held.num_rows:
            yield from flush(held)

    schema = "packed_key binary, first int, windows int"
    return strings.repartition("mini", "sub").sortWithinPartitions("mini", "sub").mapInArrow(kernel, schema)


def count_windows(strings: DataFrame, length: int) -> DataFrame:
    """As :func:`count_in_buckets`, for strings of buckets without bound: every window is spread by its own hash."""
    names = ["window", "packed_key", "first", "lo", "several"]
    id_type = strings.schema["lo"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups_of(texts):
                sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
                count = sizes - length + 1
                string = np.repeat(np.arange(b - a), count)
                within = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
                value = piece_hashes(code_points(texts[a:b]), length)[np.repeat(np.cumsum(sizes) - sizes, count) + within]
                of = lambda i: batch.column(i).take(pa.array(string + a))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), of(0), pa.array(within.astype(np.int32)), of(2), of(3)], names)

    windows = strings.select("packed_key", "packed", "lo", "several").mapInArrow(kernel, f"window long, packed_key binary, first int, lo {id_type}, several boolean")
    shared = lambda df, key: df.groupBy(key).agg(F.min("lo").alias("a"), F.max("lo").alias("b"), F.max("several").alias("s")).where("s or a <> b").select(key)
    likely = materialize(windows.join(shared(windows, "window"), "window"), "likely-windows")
    text = F.expr(f"substring(packed, first + 1, {length})").alias("text")
    exact = likely.join(strings.select("packed_key", "packed"), "packed_key").select(text, "packed_key", "first", "lo", "several")
    return exact.join(shared(exact, "text"), "text").select("packed_key", "first", F.lit(1).alias("windows"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Union of the intervals ``(id, a, b)`` per id as maximal disjoint ``(id, span_start, span_end)``."""
    before = Window.partitionBy("id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("int"))
    return (
        marked.withColumn("island", F.sum("new").over(upto))
        .groupBy("id", "island")
        .agg(F.min("a").alias("span_start"), F.max("b").alias("span_end"))
        .drop("island")
    )


def shared_spans(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    word: int = WORD,
    hot: int = HOT,
) -> DataFrame:
    """``(id, span_start int, span_end int)``: the maximal runs of characters of each text that lie in
    a run of ``length`` characters standing verbatim in the text of another id."""
    word = min(word, length)
    kmers = materialize(super_kmers(documents, id_col, text_col, length, word), "superkmers")
    shared = (
        kmers.groupBy("mini")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
        .where("lo <> hi")
        .select("mini", (F.col("n") > hot).alias("hot"))
    )
    kept = materialize(kmers.join(shared, "mini"), "sharedkmers")
    drop_materialized(kmers)
    texts = (
        documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where(F.char_length("text") >= length)
        .join(kept.select("id").distinct(), "id", "left_semi")
        .groupBy("id")  # rows delivered twice are one document
        .agg(F.collect_set("text").alias("texts"))
        .select("id", F.explode("texts").alias("text"))
    )
    pieces = (
        kept.distinct()
        .join(texts, "id")
        .select("mini", "id", "start", F.expr(f"substring(text, start + 1, windows + {length - 1})").alias("packed"), "hot")
        .where(F.char_length("packed") >= length)
    )
    second = min(SECOND_WORD, word)
    strings = split_hot(pieces, length, second)
    strings = materialize(strings.withColumn("packed_key", F.unhex(F.sha2("packed", 256))), "packed")
    drop_materialized(kept)
    # buckets that two minimisers could not cut small enough
    crowded = strings.groupBy("mini", "sub").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("mini", "sub")
    distinct = lambda df: df.groupBy("mini", "sub", "packed", "packed_key").agg(F.min("id").alias("lo"), (F.min("id") != F.max("id")).alias("several"))
    runs = count_in_buckets(distinct(strings.join(crowded, ["mini", "sub"], "left_anti")), length)
    runs = runs.unionByName(count_windows(distinct(strings.join(crowded, ["mini", "sub"], "left_semi")), length))
    back = strings.select("packed_key", "id", "start").join(runs, "packed_key")
    at = F.col("start") + F.col("first")
    spans = merge_runs(back.select("id", at.alias("a"), (at + F.col("windows") + (length - 1)).alias("b")))
    return spans.select(F.col("id").alias(id_col), "span_start", "span_end")


def shared_amount(
    documents: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document row: characters, shared characters, their share (0 for null and empty texts) and spans."""
    sums = spans.groupBy(id_col).agg(
        F.sum(F.col("span_end") - F.col("span_start")).cast("long").alias("shared_chars"), F.count("*").alias("spans")
    )
    sizes = documents.select(id_col, F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return sizes.join(sums, id_col, "left").select(
        id_col,
        "chars",
        shared.alias("shared_chars"),
        F.when(F.col("chars") > 0, shared / F.col("chars")).otherwise(F.lit(0.0)).alias("shared_share"),
        F.coalesce("spans", F.lit(0)).alias("spans"),
    )
