"""A sink that writes one file for each row, such as repaired page images.

    spark.dataSource.register(ImageFiles)
    df.select("name", "content").write.format("page_files").mode("append").save(path)

Every task attempt writes into a staging folder of its own. On commit the folders of the attempts that Spark accepted are
moved in, one rename a task, and the rest of the staging area goes; so a retried or speculative task leaves no second
copy, and an aborted job leaves nothing. Files end up as ``path/part-<partition>-<job>/<name>``. Rows without content get no
file. Names keep letters, digits, dots, dashes and underscores, the latter not in front; rows of one task with equal names get a number. The
path may be any that pyarrow's file systems open and that all executors share.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Staged(WriterCommitMessage):
    """The folder of an accepted attempt, where it goes, and how many files it holds."""

    folder: str
    target: str
    files: int


class ImageFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]
        self.staging = f"{self.path}/_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        task = TaskContext.get()
        system, top = opened(self.staging)
        folder = f"{top}/{task.partitionId():05d}-{task.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        seen: dict[str, int] = {}
        n = 0
        for row in iterator:
            if row["content"] is None:
                continue
            name = re.sub(r"[^A-Za-z0-9._-]", "_", row["name"] or "unnamed").lstrip("._") or "unnamed"
            seen[name] = seen.get(name, -1) + 1
            if seen[name]:
                stem, dot, kind = name.rpartition(".")
                name = f"{stem}-{seen[name]}.{kind}" if dot else f"{name}-{seen[name]}"
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(row["content"]))
            n += 1
        return Staged(folder, f"part-{task.partitionId():05d}-{self.job}", n)

    def commit(self, messages: list[Staged | None]) -> None:
        system, top = opened(self.path)
        before = [x.path for x in system.get_file_info(fs.FileSelector(top, allow_not_found=True)) if x.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.files:
                system.move(m.folder, f"{top}/{m.target}")
        for old in before:
            system.delete_dir(old)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, top = opened(self.staging)
        if system.get_file_info(top).type != fs.FileType.NotFound:
            system.delete_dir(top)


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema: StructType, overwrite: bool) -> ImageFilesWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("columns name and content are needed")
        return ImageFilesWriter(self.options["path"], overwrite)
