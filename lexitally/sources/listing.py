"""Files of label folders without their content (JOIN-4, SRC-4, SNK-3).

Spark's file readers give no row for a file of no bytes, and a reader of texts reads them to say
that they are there. This source lists folders instead: a partition per label folder, listed
where it runs, with the name and size of every file.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Folder(InputPartition):
    def __init__(self, label: str, path: str):
        super().__init__(label)
        self.label, self.path = label, path


class FolderReader(DataSourceReader):
    def __init__(self, root: str, pattern: str):
        self.root, self.pattern = root, pattern

    def _entries(self, path: str, uri: str) -> Iterator:
        from pyarrow import fs

        place, _ = fs.FileSystem.from_uri(uri)
        return iter(place.get_file_info(fs.FileSelector(path)))

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        _, path = fs.FileSystem.from_uri(self.root)
        found = [e for e in self._entries(path, self.root) if e.type == fs.FileType.Directory]
        return [Folder(e.base_name, e.path) for e in sorted(found, key=lambda e: e.base_name)]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        from pyarrow import fs

        # a source of no folders is read as one partition of nothing
        for entry in self._entries(partition.path, self.root) if partition else ():
            if entry.type == fs.FileType.File and fnmatchcase(entry.base_name, self.pattern):
                yield partition.label, entry.base_name, entry.size


class LabelFolders(DataSource):
    """``<path>/<label>/<file>``: label, file name and size; the option ``pattern`` picks names."""

    @classmethod
    def name(cls) -> str:
        return "label_folders"

    def schema(self) -> str:
        return "emotion string, file_name string, size long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("pattern", "*"))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``emotion``, ``file_name`` and ``size`` of the files in the label folders, those of no bytes too.

    Only names and sizes are read; a folder is listed by one task, all folders side by side. A
    missing root is an error. Files directly in the root and in folders of folders are left out.
    """
    spark.dataSource.register(LabelFolders)
    place = root if "://" in root or root.startswith("file:") else f"file://{root}"
    return spark.read.format("label_folders").option("pattern", pattern).load(place)


def empty_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """The files of no bytes."""
    return list_files(spark, root, pattern).where(F.col("size") == 0).select("emotion", "file_name")
