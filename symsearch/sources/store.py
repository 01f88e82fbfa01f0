"""A folder of any file system that Spark knows, through Hadoop's own interface."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        sc = spark.sparkContext
        self._jvm, self._conf = sc._jvm, sc._jsc.hadoopConfiguration()
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = folder.getFileSystem(self._conf)
        self._folder = self._fs.makeQualified(folder)
        #: as Spark's readers and writers take it
        self.path = self._folder.toString().removeprefix("file:") or "/"

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, name) if name else self._folder

    def child(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._folder)) if self.exists() else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Write a file if there is none of that name, whole or not at all; whether it was written."""
        part = self._at(f"_part-{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        plain = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            # a rename that doesn't overwrite: of several writers one succeeds
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._folder.toUri(), self._conf).rename(part, self._at(name), plain)
            return True
        except Py4JJavaError as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def make(self) -> None:
        self._fs.mkdirs(self._folder)
