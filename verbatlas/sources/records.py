"""Delivered record text with rows that do not parse set apart (problem 5).

A small recursive-descent parser reads the grammar

    records := record (line end record)*          field  := quoted | plain
    record  := field ("," field)*                 quoted := '"' (character | '""')* '"'

and returns for every record either its fields or the first error with its place. After a broken quote the
parser resumes at the next validated record start, a line whose first field is a record id
(``document:number:number``) and whose second field is that same document, quoted or not, so one broken quote costs one
record and never the rest of the file; a quoted field that runs over such a start is a broken one. Every line that is
skipped on the way there is a record of its own with the reason ``quoting``, so nothing is lost unseen. Where the
delivery already has one record per row, the row is the record, and line ends outside quotes are ordinary characters.

Valid fields become a typed record; otherwise the first reason that applies is kept: ``quoting``, ``columns``,
``predicate_index``, ``predicate_roleset``.

Defined results: a null row has the reason ``columns`` at place 0, an empty one too (one empty field); blanks
around a plain value do not count, inside quotes they do; words and tags are cut at single spaces, an empty
value has none; an index of any number of digits is read exactly; rows delivered twice are parsed each;
texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatlas.session import materialize, ship

FIELDS = ("example_id", "document_id", "sentence_id", "words", "predicate_index", "tags", "predicate_roleset")

#: A record start: at a line start an id of document, number and number, then the same document; each quoted or with blanks around.
ANCHOR = re.compile(r'(?m)^[ \t]*(?P<q>"?)(?P<doc>[^\s",:]+):\d+:\d+(?P=q)[ \t]*,[ \t]*(?P<r>"?)(?P=doc)(?P=r)[ \t]*,')

#: Characters of a text that is cut from a file.
CHUNK = 1 << 20

DIGITS = re.compile(r"[0-9]+")
ROLESET = re.compile(r"(?:[^\W\d_]|[_-])+\.[0-9][0-9]")


@dataclass
class ParsedRecord:
    """Fields with their places, or the place and the text of the first syntax error."""

    start: int
    end: int
    fields: list[str]
    places: list[int]
    error_at: int | None = None
    error: str | None = None


class RecordParser:
    """Recursive descent over one text; ``lines`` tells whether a line end outside quotes ends a record."""

    def __init__(self, text: str, lines: bool):
        self.text, self.lines = text, lines
        self.stop = re.compile('[,"\n]') if lines else re.compile('[,"]')

    def records(self) -> Iterator[ParsedRecord]:
        at = 0
        while True:
            record = self.record(at)
            if record.error is None:
                yield record
            else:
                upto = self.resume(record)
                record.end = self.line_end(record, upto)
                yield record
                yield from self.skipped(record.end + 1, upto)
                record.end = upto
            at = record.end + 1
            if at > len(self.text) or (self.lines and at == len(self.text)):
                return

    def record(self, start: int) -> ParsedRecord:
        found = ParsedRecord(start, start, [], [])
        at = start
        while True:
            at = self.field(at, found)
            if found.error is not None or at >= len(self.text) or self.text[at] == "\n" and self.lines:
                found.end = at
                return found
            at += 1  # the comma

    def field(self, at: int, found: ParsedRecord) -> int:
        return self.quoted(at, found) if self.text.startswith('"', at) else self.plain(at, found)

    def plain(self, at: int, found: ParsedRecord) -> int:
        stop = self.stop.search(self.text, at)
        end = stop.start() if stop else len(self.text)
        if stop and stop.group() == '"':
            found.error_at, found.error = end, "a quote inside an unquoted field"
        found.fields.append(self.text[at:end].strip())
        found.places.append(at)
        return end

    def quoted(self, at: int, found: ParsedRecord) -> int:
        text, close = self.text, at
        while True:
            close = text.find('"', close + 1)
            if close < 0:
                found.error_at, found.error = at, "a quoted field without end"
                return len(text)
            if not text.startswith('"', close + 1):
                break
            close += 1
        end = close + 1
        if self.lines and "\n" in text[at:close] and self.starts_within(at, close):
            found.error_at, found.error = at, "a quoted field without end before the next record"
            return end
        if end < len(text) and text[end] != "," and not (self.lines and text[end] == "\n"):
            found.error_at, found.error = end, "text after the end of a quoted field"
        found.fields.append(text[at + 1 : close].replace('""', '"'))
        found.places.append(at)
        return end

    def starts_within(self, at: int, close: int) -> bool:
        """Whether a record starts behind ``at`` in a line that begins before ``close``."""
        end = self.text.find("\n", close)
        return ANCHOR.search(self.text, at + 1, end if end >= 0 else len(self.text)) is not None

    def resume(self, broken: ParsedRecord) -> int:
        """The end of a broken record: before the next validated record start, else the end of the text."""
        if not self.lines:
            return len(self.text)
        anchor = ANCHOR.search(self.text, broken.start + 1)
        return anchor.start() - 1 if anchor else len(self.text) - self.text.endswith("\n")


    def line_end(self, broken: ParsedRecord, upto: int) -> int:
        """The end of the line in which a broken record breaks."""
        end = self.text.find("\n", max(broken.error_at or 0, broken.start)) if self.lines else -1
        return upto if end < 0 or end > upto else end

    def skipped(self, start: int, upto: int) -> Iterator[ParsedRecord]:
        """The lines between a broken record and the next record start."""
        at = start
        while at <= upto:
            end = self.text.find("\n", at, upto)
            end = upto if end < 0 else end
            yield ParsedRecord(at, end, [], [], at, "a line between a broken record and the next record start")
            at = end + 1


def parts(value: str) -> list[str]:
    return value.split(" ") if value else []


def judge(record: ParsedRecord) -> tuple[str | None, int | None, str | None]:
    """The reason why a record is no prepared example, its place and what is wrong; all null if it is one."""
    if record.error is not None:
        return "quoting", record.error_at, record.error
    if len(record.fields) != len(FIELDS):
        return "columns", record.places[min(len(record.places), len(FIELDS)) - 1], f"{len(record.fields)} fields"
    index, roleset = record.fields[4], record.fields[6]
    if not DIGITS.fullmatch(index):
        return "predicate_index", record.places[4], "not only digits"
    bare, words = index.lstrip("0") or "0", len(parts(record.fields[3]))
    if len(bare) > 9 or int(bare) >= words:
        return "predicate_index", record.places[4], f"not below the number of words, {words}"
    if not ROLESET.fullmatch(roleset):
        return "predicate_roleset", record.places[6], "not a lemma, a dot and two digits"
    return None, None, None


SCHEMA = (
    "record_no int, example_id string, document_id string, sentence_id string, words array<string>, predicate_index int, "
    "tags array<string>, predicate_roleset string, reason string, error_at int, error string, raw string"
)


def row_of(number: int, text: str | None, record: ParsedRecord | None) -> tuple:
    if record is None:
        return (number, *[None] * 7, "columns", 0, "no text", None)
    reason, at, message = judge(record)
    raw = text[record.start : record.end]
    if reason:
        return (number, *[None] * 7, reason, at - record.start, message, raw)
    a, b, c, words, index, tags, roleset = record.fields
    return (number, a, b, c, parts(words), int(index), parts(tags), roleset, None, None, None, raw)


def parse_records(df: DataFrame, text_col: str = "line", id_col: str = "line_id", lines: bool = False) -> DataFrame:
    """Typed records of every row of ``df`` with ``reason`` null, and the others with reason, place and message.

    With ``lines`` a row is a text of many records; else each row is one record. A map over the scan.
    """
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    arrow = pa.schema(
        [("record_no", pa.int32()), *((n, pa.string()) for n in FIELDS[:3]), ("words", pa.list_(pa.string())), ("predicate_index", pa.int32()),
         ("tags", pa.list_(pa.string())), ("predicate_roleset", pa.string()), ("reason", pa.string()), ("error_at", pa.int32()), ("error", pa.string()), ("raw", pa.string())]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = [None] if text is None else RecordParser(text, lines).records()
                for number, record in enumerate(found):
                    rows.append(row_of(number, text, record))
                    owner.append(i)
            columns = list(zip(*rows)) or [()] * len(arrow)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *arrays], [id_col, *arrow.names])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(kernel, f"`{id_col}` {id_type}, {SCHEMA}")


def split_good_and_bad(parsed: DataFrame, id_col: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """The loaded records, and the rows set apart with reason, place and message."""
    good = parsed.where("reason is null").drop("reason", "error_at", "error", "raw")
    return good, parsed.where("reason is not null").select(id_col, "record_no", "reason", "error_at", "error", "raw")


def anchored_texts(lines: DataFrame, most: int = CHUNK) -> DataFrame:
    """``(file, block, part, text)``: texts that begin at record starts, from the lines of file blocks.

    ``lines`` is ``(file, block, line)``, the lines of a block one after the other in one partition. Every record start is
    where a record begins, so a block can be cut there into texts of about ``most`` characters. Only what stands before
    the first record start of a block and its last record may belong together with other blocks; these edges, a few
    records for each block, are put together by file.
    """
    ship(lines.sparkSession)
    names = ["file", "block", "part", "edge", "text"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, text, size, opened = None, 0, [], 0, False

        def piece(edge: str | None) -> pa.RecordBatch:
            nonlocal part, text, size
            made = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, part, edge, "".join(x + "\n" for x in text)), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names)
            part, text, size = part + 1, [], 0
            return made

        last: list[str] = []  # the record that is open, as the text before it may be sent on
        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != key:
                    if opened and text:
                        yield piece(None)
                    if last:
                        text = last
                        yield piece("tail" if opened else "head")
                    key, part, text, size, opened, last = (file, block), 0, [], 0, False, []
                if ANCHOR.match(line):
                    if opened:
                        text += last
                        size += sum(map(len, last))
                        if size >= most:
                            yield piece(None)
                    elif last:
                        text = last
                        yield piece("head")
                    opened, last = True, []
                last.append(line)
        if opened and text:
            yield piece(None)
        if last:
            text = last
            yield piece("tail" if opened else "head")

    pieces = materialize(lines.select("file", "block", "line").mapInArrow(kernel, "file string, block long, part int, edge string, text string"), "record-texts")
    inside = pieces.where("edge is null").select("file", "block", "part", "text")
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    edges = pieces.where("edge is not null").withColumn("run", F.sum((F.col("edge") == "tail").cast("int")).over(order))
    joined = edges.groupBy("file", "run").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("p"))
    return inside.unionByName(joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["part"].alias("part"), F.array_join("p.text", "").alias("text")))


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of text files that hold many (quoted fields may hold line ends): ``file``, the ``block`` and ``part`` of
    the file, and ``record_no`` in it. Large files are read by many tasks and cut at record starts."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    texts = anchored_texts(lines).select(F.struct("file", "block", "part").alias("place"), F.col("text").alias("line"))
    return parse_records(texts, "line", "place", lines=True).select("place.*", "*").drop("place")
