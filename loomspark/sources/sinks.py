"""Sinks of bundles: files below a folder, and one archive. Tasks write, the driver commits; what no commit names is thrown away.

Folders and archives lie in a file system that the driver and all executors have mounted. A commit checks that it sees what the
tasks wrote, so that a folder which is not shared ends in an error and not in files on many machines.
"""

from __future__ import annotations

import os
import shutil
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from loomspark.operators import graph

#: Moves that a commit has under way at once.
MOVES = 32


class NotShared(OSError):
    """The driver does not see what a task wrote."""


def _local(folder: str) -> Path:
    """A folder as a path; addresses of other file systems are refused."""
    if "://" in folder.removeprefix("file://"):
        raise ValueError(f"{folder} is no folder of a mounted file system")
    return Path(folder.removeprefix("file://"))


def _inside(path: str) -> str:
    """`path`, unless it leaves the bundle's folder."""
    parts = path.split("/")
    if path.startswith("/") or ".." in parts or "" in parts or "." in parts or "\0" in path:
        raise ValueError(f"{path!r} leaves the bundle's folder")
    return path


def _drop(folder: Path) -> None:
    """Deletes a job's folder, though tasks of a failed job may still be writing to it."""
    for wait in (0, 0.1, 0.5, 2):
        time.sleep(wait)
        shutil.rmtree(folder, ignore_errors=True)
        if not folder.exists():
            return


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task wrote: its own folder, how many files and bytes."""

    attempt: str
    files: int
    size: int


class FolderWriter(DataSourceWriter):
    """Writes (path, content) rows; each attempt has a folder of its own below the job's, and a commit moves the files of the attempts that count."""

    def __init__(self, folder: str):
        self.target = _local(folder)
        self.staging = self.target.parent / f".{self.target.name}-{uuid.uuid4().hex}"
        self.staging.mkdir(parents=True)  # tasks make no parents: one that is late finds the job gone

    def write(self, rows: Iterator) -> Written:
        task = TaskContext.get()
        attempt = f"{task.partitionId() if task else 0}-{uuid.uuid4().hex}"
        own, files, size = self.staging / attempt, 0, 0
        own.mkdir()
        for path, content in rows:
            at = own / _inside(path)
            for folder in [*at.relative_to(own).parents][::-1]:
                (own / folder).mkdir(exist_ok=True)
            with open(at, "xb") as out:  # a path that stands twice in a task is an error
                size += out.write((content or "").encode())
            files += 1
        return Written(attempt, files, size)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves every file to its place; the folder then holds the whole bundle. A file that was there under the same name is replaced."""
        done = [m for m in messages if m is not None]
        for m in done:
            if not (self.staging / m.attempt).is_dir() or sum(len(names) for _, _, names in os.walk(self.staging / m.attempt)) != m.files:
                self.abort(messages)
                raise NotShared(f"{self.target} is not shared: {m.files} files of a task are not there")

        def moves() -> Iterator[tuple[Path, Path]]:
            for m in done:
                own = self.staging / m.attempt
                for folder, _, names in os.walk(own):
                    to = self.target / os.path.relpath(folder, own)
                    to.mkdir(parents=True, exist_ok=True)
                    yield from ((Path(folder, name), to / name) for name in names)

        self.target.mkdir(parents=True, exist_ok=True)
        with ThreadPoolExecutor(MOVES) as pool:
            for some in batched(moves(), 100 * MOVES):
                list(pool.map(lambda move: os.replace(*move), some))
        _drop(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        """Drops all that the job wrote; the folder stays as it was."""
        _drop(self.staging)


class FolderSink(DataSource):
    """`bundle_folder`: the rows (path, content) of a DataFrame as files below the option `path`."""

    @classmethod
    def name(cls) -> str:
        return "bundle_folder"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"])


def _refuse_twice(files: DataFrame) -> None:
    """A narrow job: contents are not read for it."""
    twice = files.groupBy("path").count().where("count > 1 or path is null").first()
    if twice is not None:
        raise ValueError(f"{twice.path!r} stands more than once or is null")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each (path, content) below a shared folder, when called: all files or, where a task or the job fails, none. Returns (path, bytes).

    A retried or repeated task leaves one file a path. Paths that leave the folder and paths that stand twice are refused; null content is empty.
    """
    _local(folder)
    _refuse_twice(files)
    files.sparkSession.dataSource.register(FolderSink)
    files.select("path", "content").write.format("bundle_folder").option("path", folder).mode("append").save()
    return files.select("path", F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("bytes"))


# ---------------------------------------------------------------- archives

_LOCAL, _CENTRAL = struct.Struct("<4sHHHHHLLLHH"), struct.Struct("<4sHHHHHHLLLHHHHHLL")
_MOST, _UTF8, _DEFLATED, _DATE = 0xFFFFFFFF, 0x800, 8, 0x21


def _member(path: bytes, content: bytes) -> tuple[bytes, int, int, int]:
    """(bytes in the archive, check sum, compressed and plain size) of one file; sizes beyond 32 bits stand in a ZIP64 field."""
    squeeze = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = squeeze.compress(content) + squeeze.flush()
    crc, small, big = zlib.crc32(content), len(packed), len(content)
    extra = struct.pack("<HHQQ", 1, 16, big, small) if max(small, big) >= _MOST else b""
    sizes = (_MOST, _MOST) if extra else (small, big)
    head = _LOCAL.pack(b"PK\3\4", 45 if extra else 20, _UTF8, _DEFLATED, 0, _DATE, crc, *sizes, len(path), len(extra))
    return head + path + extra + packed, crc, small, big


def _entry(path: bytes, crc: int, small: int, big: int, offset: int) -> bytes:
    """A file's row in the directory at the archive's end."""
    wide = [x for x in (big, small, offset) if x >= _MOST]
    extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    version = 45 if wide else 20
    return _CENTRAL.pack(b"PK\1\2", version, version, _UTF8, _DEFLATED, 0, _DATE, crc, min(small, _MOST), min(big, _MOST), len(path), len(extra), 0, 0, 0, 0, min(offset, _MOST)) + path + extra


def _end(count: int, size: int, offset: int) -> bytes:
    """What closes an archive whose directory has `count` rows of `size` bytes in all, from `offset` on."""
    out = b""
    if count >= 0xFFFF or max(size, offset) >= _MOST:
        out = struct.pack("<4sQHHLLQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, offset) + struct.pack("<4sLQL", b"PK\6\7", 0, offset + size, 1)
    return out + struct.pack("<4sHHHHLLH", b"PK\5\6", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, _MOST), min(offset, _MOST), 0)


def write_zip(files: DataFrame, target: str) -> int:
    """Writes (path, content) as one archive, its members in the order of their paths; returns how many it holds.

    Tasks deflate members into parts; the driver adds up the parts' sizes, a row each; tasks write the directory's rows for their part
    and put all into the one file at their places. Nothing but those sizes passes the driver. The archive appears when it is whole.
    """
    spark, at = files.sparkSession, _local(target)
    _refuse_twice(files)
    job = at.parent / f".{at.name}-{uuid.uuid4().hex}"
    job.mkdir(parents=True)
    folder = str(job)

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, offset = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", 0
        with open(Path(folder, name), "xb") as out:
            for batch in batches:
                rows = []
                for path, content in zip(*(batch.column(k) for k in (0, 1))):
                    path = _inside(path.as_py()).encode()
                    data, *said = _member(path, (content.as_py() or "").encode())
                    rows.append((name, path, *said, offset))
                    offset += out.write(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["part", "path", "crc", "small", "big", "at"])

    try:
        ordered = files.select("path", "content").repartitionByRange("path").sortWithinPartitions("path")
        members = graph.cut_lineage(ordered.mapInArrow(deflate, "part string, path binary, crc long, small long, big long, at long"))
        parts = sorted(members.groupBy("part").agg(F.count("*").alias("n"), F.min("path").alias("first")).collect(), key=lambda r: r.first)  # a row per part
        starts, place = {}, 0
        for r in parts:
            if not (job / r.part).is_file():
                raise NotShared(f"{job.parent} is not shared: a part is not there")
            starts[r.part] = place
            place += (job / r.part).stat().st_size
        known = spark.sparkContext.broadcast(starts)
        whole = job / "whole"
        whole.touch()

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, list] = {}
            for batch in batches:
                for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    held.setdefault(part, []).append(row)
            for part, rows in held.items():
                said = b"".join(_entry(path, crc, small, big, known.value[part] + offset) for path, crc, small, big, offset in sorted(rows))
                name = f"{part}-directory-{uuid.uuid4().hex}"
                Path(folder, name).write_bytes(said)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([len(said)], pa.int64())], ["part", "name", "size"])

        listed = members.repartition(max(1, len(parts)), "part").mapInArrow(direct, "part string, name string, size long") if parts else None
        listed = {r.part: r for r in graph.cut_lineage(listed).collect()} if parts else {}  # a row per part
        pieces, begin = [(r.part, starts[r.part]) for r in parts], place
        for r in parts:
            pieces.append((listed[r.part].name, place))
            place += listed[r.part].size

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, offset in zip(*(c.to_pylist() for c in batch.columns)):
                    with open(Path(folder, name), "rb") as piece, open(Path(folder, "whole"), "r+b") as out:
                        out.seek(offset)
                        shutil.copyfileobj(piece, out, 1 << 20)
                yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

        if pieces:  # a repeated task writes the same bytes at the same place
            spark.createDataFrame(pieces, "name string, at long").repartition(len(pieces)).mapInArrow(put, "name string").count()
        n = sum(r.n for r in parts)
        with open(whole, "r+b") as out:
            out.seek(place)
            out.write(_end(n, place - begin, begin))
        os.replace(whole, at)
        return n
    finally:
        _drop(job)
