"""Small files of a folder, through Hadoop's file systems: works for every path Spark itself can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        top = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = top.getFileSystem(self._conf)
        self.root = self.fs.makeQualified(top).toString()
        self.fs.mkdirs(top)

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _at(self, path: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        """Entries of a folder; none if it isn't there."""
        at = self._at(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._at(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str, part: str) -> bool:
        """Write a file that must not be there yet, in one step: written as `part`, then renamed without overwriting."""
        self.fs.mkdirs(self._at(path).getParent())
        stream = self.fs.create(self._at(part), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
        try:
            files.rename(self._at(part), self._at(path), options)
        except Exception as error:
            self.delete(part)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self._at(path), True)
