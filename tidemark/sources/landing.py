"""A Python data source for landed documents: ``format("landing").option("path", ...)`` gives one row per file, as a table and as a stream.

Files are listed and read through Arrow's file systems, so ``path`` may be a folder that all executors see or the address of an object store or cluster. A
stream's offset is the adapter's cursor: the change time and path of the last file that it has taken, so a restarted stream goes on behind it and lists
again only what is newer. Files must come with later change times than those that were taken (as files renamed or written whole into the folder do).
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, source_id string, body string"


class _Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class _Folder:
    """The folder's files, and how one of them is read."""

    def __init__(self, options: dict) -> None:
        self.address = options["path"]
        self.per_task = int(options.get("filesPerTask", "64"))

    def system(self):
        from pyarrow import fs

        if "://" in self.address or self.address.startswith("file:"):
            address = self.address.replace("file:///", "/").replace("file:/", "/")
            if "://" in address:
                return fs.FileSystem.from_uri(address)
            return fs.LocalFileSystem(), address
        return fs.LocalFileSystem(), self.address

    def listed(self) -> list[tuple[int, str]]:
        """``(change time in ns, path)`` of every file, in that order."""
        from pyarrow import fs

        system, folder = self.system()
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File)

    def dealt(self, files: list[str]) -> list[InputPartition]:
        return [_Files(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)]

    def rows(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = self.system()
        for path in partition.files:
            with system.open_input_stream(path) as f:
                yield path, posixpath.splitext(posixpath.basename(path))[0], f.read().decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def partitions(self) -> list[InputPartition]:
        return self.folder.dealt(sorted(path for _, path in self.folder.listed())) or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.folder.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are ``{"time": change time, "path": path}`` of the last file that a batch takes; it takes all files behind the one before."""

    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.folder.listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.folder.dealt([path for time, path in self.folder.listed() if low < (time, path) <= high])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint holds the cursor."""


class Landing(DataSource):
    """The extension point of source adapters: subclass it, and give ``schema`` and readers."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Landing)
