"""Small file operations through Hadoop, so that a database can be in any store Spark knows."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, p: str, text: str) -> None:
        """Writes a file beside ``p`` and moves it there in one step."""
        new = self.path(p + ".new")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.gateway.new_array(rename, 1)
        array[0] = rename.OVERWRITE
        context.rename(new, self.path(p), array)

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def ages(self, p: str) -> list[tuple[str, float]]:
        """(name, time of the last change) of what is in a folder."""
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self.path(p))] if self.exists(p) else []

    @contextmanager
    def turn(self, p: str, lease: float):
        """Holds the lock file ``p``: only one at a time can create it.  One older than ``lease`` seconds is void."""
        path = self.path(p)
        while True:
            try:
                self.fs.create(path, False).close()
                break
            except Exception:
                try:
                    made = self.fs.getFileStatus(path).getModificationTime() / 1000
                except Exception:  # gone meanwhile
                    continue
                if time.time() - made > lease:
                    self.fs.delete(path, False)
                else:
                    time.sleep(0.05)
        try:
            yield
        finally:
            self.fs.delete(path, False)
