"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs, abfs or a plain path)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str):
    """A stream whose file takes its name only when it is whole, so a task that is run again replaces it."""
    where, path = open_fs(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    ctx = TaskContext.get()
    part = f"{path}.{ctx.taskAttemptId() if ctx else 0}.part"
    with where.open_output_stream(part) as out:
        yield out
    where.move(part, path)


def read_all(uri: str) -> bytes:
    where, path = open_fs(uri)
    with where.open_input_stream(path) as f:
        return f.read()


class Ranged:
    """Random reads of one file."""

    def __init__(self, uri: str):
        where, path = open_fs(uri)
        self.file = where.open_input_file(path)
        self.size = self.file.size()

    def at(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        return self.file.read_at(n, start) if n else b""

    def close(self) -> None:
        self.file.close()
