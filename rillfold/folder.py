"""A folder that all of a cluster sees, through its file system: names, small files, atomic publication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class SharedFolder:
    """Paths below one folder. Small texts appear whole or not at all: they are written aside and renamed."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        fs = spark._jvm.org.apache.hadoop.fs
        self._path = fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = fs.FileContext.getFileContext(self._path(self.folder).toUri(), spark._jsc.hadoopConfiguration())
        self._rename = fs.Options.Rename
        self._gateway = spark._sc._gateway

    def path(self, name: str):
        return self._path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str) -> list[str]:
        """What lies in a folder, but for hidden files."""
        p = self.path(name)
        return sorted(x for s in (self._fs.listStatus(p) if self._fs.exists(p) else []) if not (x := s.getPath().getName()).startswith((".", "_")))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self.path(name))

    def move(self, old: str, new: str) -> None:
        if not self._fs.rename(self.path(old), self.path(new)):
            raise OSError(f"can't move {old} to {new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def table(self, name: str, schema: str) -> DataFrame:
        """The Parquet table of that name; without rows if there is none."""
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if self.names(name) else self.spark.createDataFrame([], schema)

    def text(self, name: str) -> str | None:
        p = self.path(name)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str, replace: bool = False) -> bool:
        """Write a small file; False if it exists already and isn't to be replaced.

        A reader never sees half of it, and of several writers one wins: the rename without overwrite is atomic on
        file systems with atomic renames (HDFS, local, mounted); an object store needs a committer that offers that.
        """
        new = self.path(f".{uuid.uuid4().hex}")
        stream = self._fs.create(new, False)
        stream.write(text.encode())
        stream.close()
        options = self._gateway.new_array(self._rename, 1)
        options[0] = self._rename.OVERWRITE if replace else self._rename.NONE
        try:
            self._context.rename(new, self.path(name), options)
        except Exception as e:
            self._fs.delete(new, False)
            if not replace and ("FileAlreadyExists" in str(e) or "already exists" in str(e)):
                return False
            raise
        return True
