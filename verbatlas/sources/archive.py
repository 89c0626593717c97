"""ZIP archives as tables of members, and text decoding.

``read_archive`` plans partitions by member ranges of like compressed size, so a large archive, or a folder of many, is
read by many tasks; members that do not match the wanted prefixes are never decompressed. Such archives must lie where
all executors can open them as files. ``read_archives`` takes any path that Spark reads (a bucket, HDFS), one archive in
a task; ``fingerprints`` does so too.

Defined results: directories are rows without content; an encrypted member has no content and no checksum verdict; a
damaged member has ``crc_ok`` false and no content; undecodable bytes have a null text and the encoding ``none``;
empty and null contents decode to an empty text and to null.
"""

from __future__ import annotations

import glob
import hashlib
import io
import os
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verbatlas.session import ship

PARTITION_BYTES = 32 << 20
SCHEMA = (
    "archive string, position int, path string, is_dir boolean, size bigint, compressed bigint, flags int, "
    "external_attr bigint, crc_ok boolean, content binary"
)

#: Encodings tried in order.
ENCODINGS = ("utf-8-sig", "utf-16", "cp1252")


class MemberRange(InputPartition):
    def __init__(self, archive: str, first: int, last: int):
        super().__init__((archive, first, last))


def member_rows(archive: str, opened: zipfile.ZipFile, first: int, last: int | None, with_content: bool, prefixes: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for the members ``first`` to ``last`` of an open archive."""
    for i, info in enumerate(opened.infolist()[first:last], first):
        content, fine = None, None
        wanted = not prefixes or info.filename.startswith(prefixes)
        if not info.is_dir() and not info.flag_bits & 1 and with_content and wanted:
            try:
                content, fine = opened.read(info), True
            except (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError):
                fine = False
        yield (archive, i, info.filename, info.is_dir(), info.file_size, info.compress_size, info.flag_bits, info.external_attr, fine, content)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.content = str(options.get("content", "true")).lower() == "true"
        self.prefixes = tuple(p for p in str(options.get("prefixes", "")).split("|") if p)

    def partitions(self) -> list[MemberRange]:
        ranges = []
        for archive in sorted(glob.glob(self.pattern)):
            with zipfile.ZipFile(archive) as opened:
                first = size = 0
                infos = opened.infolist()
                for i, info in enumerate(infos):
                    size += info.compress_size
                    if size >= PARTITION_BYTES:
                        ranges.append(MemberRange(archive, first, i + 1))
                        first, size = i + 1, 0
                if first < len(infos):
                    ranges.append(MemberRange(archive, first, len(infos)))
        return ranges

    def read(self, partition: MemberRange) -> Iterator[tuple]:
        archive, first, last = partition.value
        with zipfile.ZipFile(archive) as opened:
            yield from member_rows(archive, opened, first, last, self.content, self.prefixes)


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").load(path)``; options ``content`` and ``prefixes`` (joined by ``|``)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def read_archive(spark: SparkSession, path: str, content: bool = True, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """The members of the archives at ``path`` (a file or a pattern)."""
    ship(spark)
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("content", str(content).lower()).option("prefixes", "|".join(prefixes)).load(path)


def members_of(files: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """The members of archives given as ``(path, content)``; a content that is no archive has one row without path."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as opened:
                        for row in member_rows(path, opened, 0, None, True, prefixes):
                            rows.append(row)
                            size += len(row[-1] or b"")
                            if size >= PARTITION_BYTES:
                                yield batch_of(rows)
                                rows, size = [], 0
                except zipfile.BadZipFile:
                    rows = [(path, None, None, False, None, None, 0, 0, False, None)]
                if rows:
                    yield batch_of(rows)

    return files.select("path", "content").mapInArrow(kernel, SCHEMA)


def read_archives(spark: SparkSession, path: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """The members of the archives at any path that Spark reads; each at most 2 GB, read by one task."""
    return members_of(spark.read.format("binaryFile").load(path), prefixes)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, bytes, sha256)`` of files at any path that Spark reads."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint(path: str) -> tuple[str, int, str]:
    """File name, bytes and SHA-256 of a file, read in parts."""
    digest = hashlib.sha256()
    with open(path, "rb") as source:
        while part := source.read(1 << 20):
            digest.update(part)
    return os.path.basename(path), os.path.getsize(path), digest.hexdigest()


def check_pin(path: str, name: str, size: int, sha256: str) -> dict[str, bool]:
    """Whether a file is the expected one, checked before any member is read."""
    found = fingerprint(path)
    return {"filename": found[0] == name, "bytes": found[1] == size, "sha256": found[2] == sha256}


def decode_bytes(payload: bytes | None) -> tuple[str | None, str | None]:
    if payload is None:
        return None, None
    for encoding in ENCODINGS:
        try:
            return payload.decode(encoding), encoding
        except UnicodeError:
            continue
    return None, "none"


def decoded(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Replaces the bytes by ``text`` and ``encoding``."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != content_col]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [decode_bytes(p) for p in batch.column(len(keep)).to_pylist()]
            texts, encodings = pa.array([t for t, _ in pairs], pa.string()), pa.array([e for _, e in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), texts, encodings], [*keep, "text", "encoding"])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(content_col)).mapInArrow(kernel, f"{types}, text string, encoding string")
