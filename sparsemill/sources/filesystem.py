"""File operations over Hadoop's FileSystem, so an index may lie on any storage that Spark can write."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A directory. ``replace`` writes a file whole or not at all; ``create_new`` fails where the file exists."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def list(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create_new(self, name: str, text: str) -> bool:
        try:
            self._write(name, text, overwrite=False)
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        return True

    def replace(self, name: str, text: str) -> None:
        self._write(f"{name}.tmp", text, overwrite=True)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf) if self._path().toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        options = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(self._path(f"{name}.tmp")), context.makeQualified(self._path(name)), options)
