"""A11 as a sink: a Python data source whose writer commits export files.

Each task writes its files into a staging folder of its own attempt. Only the driver's commit moves the
files of the attempts that Spark accepted into place, so that readers see none of a job that is not done; a repeated
task leaves one file, a failed job none. Folders are reached by URI through Arrow's file systems (local or mounted,
HDFS, S3, GCS).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "export_files"
_PLAIN = " ()+,=@~"


def safe_name(name: str) -> str:
    """A file name of one folder: other characters as ``%XX``, so that different names stay different."""
    return quote(name, safe=_PLAIN) if name.strip(".") else name.replace(".", "%2E") or "%00"


@dataclass
class Staged(WriterCommitMessage):
    """The folder of one accepted attempt."""

    folder: str
    files: int


class ExportWriter(DataSourceWriter):
    def __init__(self, path: str, fail_after: int | None = None):
        self.path, self.fail_after = path, fail_after
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _open(self):  # noqa: ANN202
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return system, base

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, base = self._open()
        folder = posixpath.join(base, self.staging, uuid.uuid4().hex)  # a repeated task has a folder of its own
        system.create_dir(folder)
        n = 0
        for row in iterator:
            if self.fail_after is not None and n >= self.fail_after:
                raise OSError("no room left")  # for tests
            with system.open_output_stream(posixpath.join(folder, safe_name(row["filename"]))) as out:
                out.write((row["content"] or "").encode())
            n += 1
        return Staged(folder, n)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, base = self._open()
        for m in messages:
            if m is not None:
                for f in system.get_file_info(fs.FileSelector(m.folder)):
                    to = posixpath.join(base, f.base_name)
                    if system.get_file_info(to).type != fs.FileType.NotFound:
                        system.delete_file(to)  # an earlier export of this name is replaced
                    system.move(f.path, to)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, base = self._open()
        if system.get_file_info(posixpath.join(base, self.staging)).type != fs.FileType.NotFound:
            system.delete_dir(posixpath.join(base, self.staging))


class ExportFiles(DataSource):
    """``df.write.format("export_files").option("path", folder)`` for rows ``filename, content``; files in the
    folder that have other names stay."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ExportWriter:
        if not {"filename", "content"} <= set(schema.names):
            raise ValueError("exports have the columns filename and content")
        fail = self.options.get("fail_after")
        return ExportWriter(self.options["path"], int(fail) if fail else None)


def write_exports(exports: DataFrame, path: str, **options: str) -> None:
    """Each row of ``filename, content`` as a file under ``path``, all at once when the job commits."""
    spark = exports.sparkSession
    spark.dataSource.register(ExportFiles)
    exports.select("filename", "content").write.format(FORMAT).mode("append").option("path", path).options(**options).save()
