"""Small driver-side files in any store that Spark reads, through Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


class FileStore:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        where, store = self._at(path)
        return store.exists(where)

    def list(self, path: str) -> list[str]:
        where, store = self._at(path)
        return sorted(x.getPath().toString() for x in store.listStatus(where)) if store.exists(where) else []

    def read(self, path: str) -> str:
        where, store = self._at(path)
        stream = store.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written beside and renamed, so a reader sees all or nothing."""
        where, store = self._at(path)
        beside, _ = self._at(f"{path}.part")
        stream = store.create(beside, True)
        stream.write(text.encode())
        stream.close()
        store.delete(where, False)
        store.rename(beside, where)

    def delete(self, path: str) -> None:
        where, store = self._at(path)
        store.delete(where, True)
