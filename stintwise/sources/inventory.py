"""File inventory as a data source: size, SHA-256 and NUL bytes of files of any size, read in chunks.

``spark.read.format("file_inventory").load(folder)`` lists the folder once and deals its files to
tasks by size. A task holds one chunk of one file at a time, so no file has to fit in a cell.
Names that start with ``_`` or ``.`` are left out, as Spark's own readers do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_BYTES = 1 << 22
#: Bytes and files of a task, unless one file alone is larger.
TASK_BYTES = 128 << 20
TASK_FILES = 1000
SCHEMA = "path string, length long, sha256 string, nul_bytes long, nul_at long"


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder)


class InventoryReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _open(self.folder)
        inside = len(base.rstrip("/")) + 1
        found = [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File
                 and not any(part[:1] in "_." for part in f.path[inside:].split("/"))]
        tasks, held, total = [], [], 0
        for path, size in sorted(found):
            if held and (total + size > TASK_BYTES or len(held) == TASK_FILES):
                tasks.append(Files(held))
                held, total = [], 0
            held.append(path)
            total += size
        return tasks + [Files(held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, base = _open(self.folder)
        inside = len(base.rstrip("/")) + 1
        for path in partition.paths:
            digest, length, nuls, first = hashlib.sha256(), 0, 0, None
            with store.open_input_stream(path) as file:
                while chunk := file.read(CHUNK_BYTES):
                    digest.update(chunk)
                    here = chunk.count(0)
                    if here and first is None:
                        first = length + chunk.index(0)
                    nuls += here
                    length += len(chunk)
            yield path[inside:], length, digest.hexdigest(), nuls, first


class FileInventory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return InventoryReader(self.options["path"])


def read_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files actually present: path relative to the folder, length, sha256, nul_bytes, and nul_at, where the first one is."""
    spark.dataSource.register(FileInventory)
    return spark.read.format("file_inventory").load(folder)
