"""Small files on any file system that Spark reaches: a local folder, HDFS, an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._conf), place

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, path: str, data: bytes) -> None:
        """A new file that nobody reads yet."""
        fs, p = self._at(path)
        stream = fs.create(p, True)
        stream.write(bytearray(data))
        stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces a file as a whole: a reader sees the old text or the new one."""
        fs, p = self._at(path)
        new = self._jvm.org.apache.hadoop.fs.Path(path + ".new")
        self.put(path + ".new", text.encode())
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(new, p):
            raise OSError(f"cannot publish {path}")

    def recover(self, path: str) -> None:
        """Finishes a replacement that broke off after the old file was removed."""
        if not self.exists(path) and self.exists(path + ".new"):
            fs, p = self._at(path)
            fs.rename(self._jvm.org.apache.hadoop.fs.Path(path + ".new"), p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def delete_at_end(self, path: str) -> None:
        """Deletes a folder that exists when the application ends."""
        fs, p = self._at(path)
        fs.deleteOnExit(p)
