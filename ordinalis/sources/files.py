"""Small files through Hadoop's file systems, so that a store can lie wherever Spark can write."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def make_folder(self, name: str = "") -> None:
        self.fs.mkdirs(self.path(name))

    def read(self, name: str) -> str:
        stream = None
        try:
            stream = self.fs.open(self.path(name))
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Py4JJavaError as e:
            raise OSError(f"{self.root}/{name} can't be read: {e.java_exception.getMessage()}") from e
        finally:
            if stream is not None:
                stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces the file in one step: readers see the old text or the new."""
        other = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(other), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(self.path(other)), context.makeQualified(self.path(name)), options)

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
