"""Small files of the shared folder, by Hadoop's file systems, so that a folder may be anywhere Spark can write."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Somebody else was first."""


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self.local = self._fs.getScheme() == "file"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _file(self, name: str) -> str:
        """A local file's name."""
        return self._path(name).toUri().getPath()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def read(self, name: str) -> bytes:
        if self.local:
            with open(self._file(name), "rb") as f:
                return f.read()
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes, *, new: bool = False) -> None:
        """Writes a whole file; ``new``: only if there is none, or else ``Conflict``."""
        path = self._path(name)
        if self.local:
            import os

            self._fs.mkdirs(path.getParent())
            to = self._file(name)
            if new:
                try:
                    with open(to, "xb") as f:
                        f.write(data)
                except FileExistsError:
                    raise Conflict(name) from None
            else:
                with open(f"{to}.tmp-{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f.name, to)
            return
        if new and self._fs.exists(path):
            raise Conflict(name)
        try:
            out = self._fs.create(path, not new)
        except Exception as e:
            if new and self._fs.exists(path):
                raise Conflict(name) from e
            raise
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def list(self, name: str) -> list[str]:
        """Names in a folder, in order, without hidden and temporary ones."""
        path = self._path(name)
        if not self._fs.exists(path):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(path)]
        return sorted(n for n in found if not n.startswith((".", "_")) and ".tmp-" not in n)

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(name), True)

    def json(self, name: str, default=None):
        try:
            return json.loads(self.read(name)) if self.exists(name) else default
        except ValueError as e:
            raise ValueError(f"{name} is damaged: {e}") from None

    @contextmanager
    def lock(self, name: str, timeout: float = 30.0, stale: float = 600.0) -> Iterator[None]:
        """Holds a lock that all processes on the folder respect; one older than ``stale`` seconds is taken over."""
        file, end = f"locks/{quote(name, safe='')}", time.time() + timeout
        while True:
            try:
                self.write(file, str(time.time()).encode(), new=True)
                break
            except Conflict:
                try:
                    age = time.time() - float(self.read(file) or b"0")
                except (OSError, ValueError):
                    age = 0.0
                if age > stale:
                    self.delete(file)
                elif time.time() > end:
                    raise TimeoutError(f"{name} is locked") from None
                else:
                    time.sleep(0.05)
        try:
            yield
        finally:
            self.delete(file)


def quoted(name: str) -> str:
    return quote(name, safe="")


def unquoted(name: str) -> str:
    return unquote(name)
