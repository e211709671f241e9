"""File names of a table folder, and file operations through Hadoop's file systems (local or remote)."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Fixed value: the name of the change log in a folder.
LOG_NAME = "MANIFEST"


def log_path(folder: str, name: str = LOG_NAME) -> str:
    return f"{folder}/{name}"


def table_path(folder: str, table_id: int) -> str:
    return f"{folder}/{table_id:06d}.sst"


class Files:
    def __init__(self, spark: SparkSession):
        self._path, self._conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files below a folder; -1 where there is none."""
        fs, at = self._at(path)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else -1

    def names(self, path: str) -> list[str]:
        """Names in a folder."""
        fs, at = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def create(self, path: str) -> bool:
        """An empty file; False where there is one already. Of several writers one succeeds."""
        fs, at = self._at(path)
        try:
            fs.create(at, False).close()
        except Exception as e:  # the file system's own exception, through the gateway
            if fs.exists(at):
                return False
            raise OSError(str(e)) from e
        return True

    def rename(self, old: str, new: str) -> bool:
        fs, at = self._at(old)
        return fs.exists(at) and fs.rename(at, self._path(new))

    def remove(self, path: str) -> bool:
        """A file; a folder only if it is empty."""
        fs, at = self._at(path)
        return fs.exists(at) and not (fs.getFileStatus(at).isDirectory() and fs.listStatus(at)) and fs.delete(at, False)

    def make_folder(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.mkdirs(at)

    def remove_folder(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.delete(at, True)
