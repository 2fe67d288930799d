"""Small files of a datastore in any file system that Spark reaches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from streamtable.errors import ConcurrentChange


class Store:
    """Paths below a root, which is a URL or a local path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._jvm = spark._jvm
        hadoop = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(hadoop).toString().rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def make_dir(self, path: str) -> None:
        self._fs.mkdirs(self._at(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        if not self.exists(path):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(path)))

    def age_ms(self, path: str) -> int:
        return self._jvm.System.currentTimeMillis() - self._fs.getFileStatus(self._at(path)).getModificationTime()

    def read_json(self, path: str) -> dict:
        stream = self._fs.open(self._at(path))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, path: str, value: dict) -> None:
        """Create a file, which shows whole or not at all; ConcurrentChange if it is there already.

        It is written beside its place and moved there: by a link in a local file system and by a rename elsewhere, both of which
        fail if the place is taken. That holds in HDFS and what behaves like it. Object stores without an exclusive rename
        leave a short gap between the look and the move, so there one process at a time may change a datastore.
        """
        folder, _, name = path.rpartition("/")
        beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(beside), False)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            if not self._place(beside, path):
                raise ConcurrentChange(path)
        finally:
            self._fs.delete(self._at(beside), False)

    def _place(self, beside: str, path: str) -> bool:
        """Put a written file in its place, which must be free."""
        if self._fs.getScheme() != "file":
            return not self.exists(path) and self._fs.rename(self._at(beside), self._at(path))
        local = lambda x: self._jvm.java.nio.file.Paths.get(self._at(x).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.String, 0))
        try:
            self._jvm.java.nio.file.Files.createLink(local(path), local(beside))
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def rename(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._at(new).getParent())
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._at(path), True)
