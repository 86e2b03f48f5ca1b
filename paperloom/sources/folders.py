"""Small files and listings in the cluster's file system, from the driver."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.gateway, self.fs, self.conf = spark.sparkContext._gateway, spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        root = self.fs.Path(path)
        self.files = root.getFileSystem(self.conf)
        self.root = self.files.makeQualified(root)

    @property
    def path(self) -> str:
        return self.root.toString()

    @property
    def scheme(self) -> str:
        return self.root.toUri().getScheme()

    def at(self, *names: str):
        place = self.root
        for name in names:
            place = self.fs.Path(place, name)
        return place

    def names(self, *below: str) -> list[str]:
        """Names of what lies in a folder, in order; none where it does not exist."""
        place = self.at(*below)
        return sorted(s.getPath().getName() for s in self.files.listStatus(place)) if self.files.exists(place) else []

    def exists(self, *names: str) -> bool:
        return self.files.exists(self.at(*names))

    def age(self, *names: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self.files.getFileStatus(self.at(*names)).getModificationTime() / 1000

    def read(self, *names: str) -> str:
        stream = self.files.open(self.at(*names))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, text: str, *names: str) -> bool:
        """Makes a file that is there whole or not at all; no if one of that name was there first."""
        hidden = self.at(*names[:-1], f"_new-{uuid.uuid4().hex}")
        stream = self.files.create(hidden)
        stream.write(bytearray(text.encode()))
        stream.close()
        without_overwrite = self.gateway.new_array(getattr(self.fs, "Options$Rename"), 0)
        try:
            self.fs.FileContext.getFileContext(hidden.toUri(), self.conf).rename(hidden, self.at(*names), without_overwrite)
        except Py4JJavaError as problem:
            self.files.delete(hidden, False)
            if "FileAlreadyExists" not in problem.java_exception.toString():
                raise
            return False
        return True

    def make(self, *names: str) -> None:
        self.files.mkdirs(self.at(*names))

    def delete(self, *names: str) -> None:
        self.files.delete(self.at(*names), True)
