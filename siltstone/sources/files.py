"""Files of a store through Hadoop's file systems, so that a store may lie wherever Spark can write."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def size(self, name: str) -> int:
        return self.fs.getFileStatus(self.path(name)).getLen()

    def names(self, name: str) -> list[str]:
        """The names in a folder; none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def sizes(self, name: str) -> dict[str, int]:
        """The sizes of all files below a folder by their paths relative to the root, in order."""
        found = {}
        if self.exists(name):
            files = self.fs.listFiles(self.path(name), True)
            top = len(self.fs.makeQualified(self.path("")).toString()) + 1
            while files.hasNext():
                status = files.next()
                found[status.getPath().toString()[top:]] = status.getLen()
        return dict(sorted(found.items()))

    def walk(self, name: str) -> list[str]:
        """The paths of all files below a folder, relative to the root."""
        return list(self.sizes(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Writes a file whole: to a temporary name, synced, then renamed."""
        temp = f"{name}.tmp"
        stream = self.fs.create(self.path(temp), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        self.move(temp, name)

    def move(self, a: str, b: str) -> None:
        self.fs.mkdirs(self.path(b).getParent())
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"{a} could not be renamed to {b}")

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)
