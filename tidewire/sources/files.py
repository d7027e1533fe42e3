"""Files of stored tables through the Hadoop file system, so that any store Spark reads can be changed in place."""

import json
import os
import uuid
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import ship_package

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Files:
    """The file system that holds ``root``. Paths are relative to it, encoded as in Spark's ``_metadata.file_path``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        top = self._jvm.org.apache.hadoop.fs.Path(root)
        self.fs = top.getFileSystem(self._conf)
        self.root = self.fs.makeQualified(top)
        self.raw = self.root.toUri().getRawPath().rstrip("/")
        self.local = self.root.toUri().getScheme() == "file"

    def path(self, relative: str):
        uri = self.root.toUri()
        return self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(
            f"{uri.getScheme()}://{uri.getRawAuthority() or ''}{self.raw}/{relative}"))

    def relative(self, file: str) -> str:
        """The path below the root of a file named by its URI."""
        raw = urlsplit(file).path
        if not raw.startswith(self.raw + "/"):
            raise ValueError(f"{file} is not below {self.raw}")
        return raw[len(self.raw) + 1:]

    def url(self, relative: str) -> str:
        """A path that Spark's readers and writers take."""
        return self.path(relative).toString()

    def exists(self, relative: str) -> bool:
        return self.fs.exists(self.path(relative))

    def stamp(self, relative: str) -> tuple[int, int] | None:
        """Size and time of change; null once the file is gone."""
        if not self.exists(relative):
            return None
        status = self.fs.getFileStatus(self.path(relative))
        return status.getLen(), status.getModificationTime()

    def children(self, relative: str = "") -> list[str]:
        here = self.path(relative) if relative else self.root
        if not self.fs.exists(here):
            return []
        paths = self._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(self.fs.listStatus(here))
        if not len(paths):
            return []
        # All paths in one call: a call for each takes seconds where a table has thousands of folders. A name has no slash,
        # so what stands between two of them cannot be part of one.
        parent = paths[0].getParent().toString().rstrip("/") + "/"
        every = self._jvm.scala.runtime.ScalaRunTime.stringOf(paths)
        names = every.removeprefix(f"Array({parent}").removesuffix(")").split(f", {parent}")
        return sorted(quote(name, safe="!$&'()*+,;=:@~") for name in names)

    def move(self, source: str, target: str) -> None:
        """Rename, replacing the target."""
        to = self.path(target)
        self.fs.mkdirs(to.getParent())
        if self.fs.exists(to):
            self.fs.delete(to, False)
        if not self.fs.rename(self.path(source), to):
            raise OSError(f"cannot move {source} to {target}")

    def remove(self, relative: str) -> None:
        self.fs.delete(self.path(relative), True)

    def drop_if_empty(self, relative: str) -> None:
        """Drop a folder without content, and those above it that are left without any."""
        while relative and self.exists(relative) and not self.children(relative):
            self.fs.delete(self.path(relative), False)
            relative = relative.rpartition("/")[0]

    def write_json(self, relative: str, value) -> None:
        """Written beside and renamed, so that a file by this name is whole."""
        folder, _, name = relative.rpartition("/")
        beside = f"{folder}/_{name}".lstrip("/")  # a name that readers pass over
        out = self.fs.create(self.path(beside), True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        self.move(beside, relative)

    def read_json(self, relative: str):
        source = self.fs.open(self.path(relative))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()


def partition_value(folder: str) -> str:
    """The value of a ``name=value`` folder as Spark has written it."""
    return unquote(unquote(folder).split("=", 1)[1])


def partition_folder(name: str, value) -> str:
    """The ``name=value`` folder that Spark writes a value to."""
    text = "" if value is None else str(value)
    return f"{name}=" + ("".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in text) or NO_VALUE)


def write_local_csv(df: DataFrame, keys: list[str], root: str) -> None:
    """The folders and rows of ``df.write.partitionBy(*keys)`` as CSV with a header, below a local (or mounted) root.

    Hadoop's local file system without native library starts a process for every file and folder it makes, which is most
    of the time where files are many and small; Python starts none. A task writes to a folder of its attempt, and only
    attempts that Spark took are moved to their place, by the driver. Column names must need no quotes.
    """
    files, fields = Files(df.sparkSession, root), [c for c in df.columns if c not in keys]
    top, run = files.root.toUri().getPath(), uuid.uuid4().hex
    work = f"{top}/_write-{run}"
    header = ",".join(fields).encode() + b"\n"
    ship_package()

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        attempt, name = f"{work}/{task.taskAttemptId()}", f"part-{task.partitionId():05d}-{run}.csv"
        here, out = None, None
        try:
            for rows in (batch.slice(k, 500) for batch in batches for k in range(0, batch.num_rows, 500)):
                for *key, line in zip(*(c.to_pylist() for c in rows.columns)):
                    if key != here:
                        if out:
                            out.close()
                        folder = "/".join([attempt, *map(partition_folder, keys, key)])
                        os.makedirs(folder, exist_ok=True)
                        # Keys that differ can share a folder (null and empty text).
                        path, here = f"{folder}/{name}", key
                        fresh = not os.path.exists(path)
                        out = open(path, "ab")
                        if fresh:
                            out.write(header)
                    out.write(line + b"\n")
        finally:
            if out:
                out.close()
        if here is not None:
            yield pa.RecordBatch.from_pydict({"attempt": [attempt]})

    line = F.to_csv(F.struct(*fields), {"escape": '"'}).cast("binary")
    try:
        made = df.select(*keys, line.alias("line")).sortWithinPartitions(*keys).mapInArrow(write, "attempt string").collect()
        os.makedirs(top, exist_ok=True)
        for row in made:
            _merge(row.attempt, top)
    finally:
        files.remove(f"_write-{run}")


def _merge(source: str, target: str) -> None:
    """Move what a local folder holds; a folder that is not there yet goes as one."""
    for entry in list(os.scandir(source)):
        to = f"{target}/{entry.name}"
        if entry.is_dir() and os.path.isdir(to):
            _merge(entry.path, to)
        else:
            os.replace(entry.path, to)
