"""Digests of files of any size, as a Spark data source.

A file is read block by block in the task that hashes it, so that no file has to fit a row. The driver lists names and
sizes only; files are dealt over partitions of about equal bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of files a partition takes, bytes read at once, and bytes of each file that are given with its digest.
PARTITION_BYTES, BLOCK_BYTES, HEAD_BYTES = 256 << 20, 1 << 20, 64 << 10
SUFFIXES = ".pdf,.txt"


@dataclass
class Files(InputPartition):
    paths: list[str]


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if ":/" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def dealt(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Paths in groups of at most `most` bytes; a larger file is a group of its own."""
    groups, room = [], 0
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if not groups or size > room:
            groups.append([])
            room = most
        groups[-1].append(path)
        room -= size
    return groups


class FileDigests(DataSource):
    """path, filename, suffix, n_bytes, sha256, head of the files of a folder whose names end in one of `suffixes`.

    Options: path; suffixes (comma-joined); partitionBytes, blockBytes, headBytes. Names that begin with a point or an
    underscore, and folders within the folder, are not read. A file that goes while it is read fails the task.
    """

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, filename string, suffix string, n_bytes long, sha256 string, head binary"

    def reader(self, schema) -> DataSourceReader:
        return FileDigestReader(dict(self.options))


class FileDigestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {name.lower(): value for name, value in options.items()}
        self.folder = given["path"]
        self.suffixes = tuple(given.get("suffixes", SUFFIXES).split(","))
        self.most = int(given.get("partitionbytes", PARTITION_BYTES))
        self.block = int(given.get("blockbytes", BLOCK_BYTES))
        self.head = int(given.get("headbytes", HEAD_BYTES))

    def partitions(self) -> list[Files]:
        system, folder = _opened(self.folder)
        found = system.get_file_info(pyarrow.fs.FileSelector(folder))
        sizes = [
            (f.path, f.size) for f in found
            if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(self.suffixes) and not f.base_name.startswith((".", "_"))
        ]
        return [Files(paths) for paths in dealt(sizes, self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        for path in partition.paths:
            digest, size, head = hashlib.sha256(), 0, b""
            with system.open_input_stream(path) as stream:
                while block := stream.read(self.block):
                    digest.update(block)
                    size += len(block)
                    if len(head) < self.head:
                        head += block[:self.head - len(head)]
            name = path.rsplit("/", 1)[-1]
            stem, point, ending = name.rpartition(".")
            yield path, name, point + ending if point else "", size, digest.hexdigest(), head


def read_digests(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The files of a folder with their digests; see `FileDigests`. The folder must be one that executors reach."""
    spark.dataSource.register(FileDigests)
    return spark.read.format(FileDigests.name()).options(**options).load(folder)
