"""A data source that writes text files one by one, with commit and abort."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """The targets of a task and the mark that its files carry until they are moved."""

    paths: list[str]
    mark: str


def _open(path: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(path, safe="/:@")) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class SidecarWriter(DataSourceWriter):
    def __init__(self):
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        # an attempt has a mark of its own, so that one that is lost or repeated leaves the others' files alone
        done = Written([], f".{self.job}-{uuid.uuid4().hex}")
        try:
            for path, text in rows:
                files, at = _open(path)
                files.create_dir(at.rpartition("/")[0], recursive=True)
                done.paths.append(path)
                with files.open_output_stream(at + done.mark) as out:
                    out.write((text or "").encode())
        except BaseException:
            self._remove([done])
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for path in m.paths if m else []:
                files, at = _open(path)
                files.move(at + m.mark, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([m for m in messages if m])

    def _remove(self, messages: list[Written]) -> None:
        for m in messages:
            for path in m.paths:
                files, at = _open(path)
                try:
                    files.delete_file(at + m.mark)
                except FileNotFoundError:
                    continue  # it was opened, not written


class SidecarFiles(DataSource):
    """Rows (path, text): each text becomes a file."""

    @classmethod
    def name(cls) -> str:
        return "easel_sidecars"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SidecarWriter()
