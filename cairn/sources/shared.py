"""Folders and files that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache
from typing import Any

from pyspark.sql import SparkSession


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cairn-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own, but only in a single process as in tests."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir()


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"


class Files:
    """Small text files beside tables, in whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> bool:
        """Put a whole file there by one rename, unless there is one already; False then."""
        target = self.path(name)
        self._fs.mkdirs(target.getParent())
        new = self.path(f"{name}.{uuid.uuid4().hex}.new")
        stream = self._fs.create(new)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(new), self._fs.makeQualified(target), options)
        except Exception as e:
            self._fs.delete(new, False)
            if "AlreadyExists" not in str(e):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))
