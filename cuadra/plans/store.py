"""Artifacts in any store: ordered files written by all executors and put together at the end, and digests of inputs.

Lines are sorted into ranges and rendered where they lie, as parts in the shared folder. Only when every part is there are
they copied, stream by stream, into a file beside the target, which then takes the target's name. A failed job leaves
nothing behind, and no more than a buffer of it passes through the driver.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import paths
from ..storage import delete, shared_dir

def uri(path: str | os.PathLike) -> str:
    """A path without a scheme is a local one."""
    text = str(path)
    return text if "://" in text or text.startswith("file:") else f"file://{os.path.abspath(text)}"


class Files:
    """The Hadoop file systems of a session."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def path(self, path: str | os.PathLike):
        return self.jvm.org.apache.hadoop.fs.Path(uri(path))

    def of(self, path: str | os.PathLike):
        system = self.path(path).getFileSystem(self.conf)
        # local files without their checksums beside them
        return system.getRawFileSystem() if uri(path).startswith("file:") else system

    def exists(self, path: str | os.PathLike) -> bool:
        return self.of(path).exists(self.path(path))

    def make_folder(self, path: str | os.PathLike) -> None:
        if not self.of(path).mkdirs(self.path(path)):
            raise OSError(f"cannot create {path}")

    def read(self, path: str | os.PathLike) -> str:
        stream = self.of(path).open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def parts(self, folder: str) -> list[tuple[object, int]]:
        """(path, bytes) of the parts of a folder that Spark wrote, in order, without empty ones."""
        found = self.path(folder).getFileSystem(self.conf).listStatus(self.path(folder))
        named = sorted(((s.getPath().getName(), s) for s in found), key=lambda x: x[0])
        return [(s.getPath(), s.getLen()) for name, s in named if name.startswith("part-") and s.getLen()]

    def put(self, target: str | os.PathLike, pieces: list[str | tuple[str, int]], keep: bool = False) -> None:
        """Write texts and the parts of folders, (folder, bytes left out at its end), one after the other.

        keep: after what the target holds already. It changes only once all is written.
        """
        beside = f"{uri(target).rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
        system = self.of(target)
        out = system.create(self.path(beside), True)
        try:
            try:
                if keep and self.exists(target):
                    self._copy(system.open(self.path(target)), out, system.getFileStatus(self.path(target)).getLen())
                for piece in pieces:
                    if isinstance(piece, str):
                        out.write(bytearray(piece.encode()))
                        continue
                    folder, cut_off = piece
                    parts = self.parts(folder)
                    for k, (path, size) in enumerate(parts):
                        self._copy(path.getFileSystem(self.conf).open(path), out, size - (cut_off if k == len(parts) - 1 else 0))
            finally:
                out.close()
            self._rename(beside, target)
        except Exception:
            system.delete(self.path(beside), False)
            raise

    def _copy(self, stream, out, size: int) -> None:
        try:
            self.jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, size)
        finally:
            stream.close()

    def _rename(self, source: str, target: str | os.PathLike) -> None:
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(source).toUri(), self.conf).rename(self.path(source), self.path(target), options)


def ordered_parts(lines: DataFrame, value: str, *order: str, separator: str) -> tuple[str, int]:
    """A folder of parts whose texts, in order of their names, are the values in order, each with a separator after it,
    and how many values there are, counted as they are written."""
    folder, seen = f"{shared_dir(lines.sparkSession)}/sink-{uuid.uuid4().hex}", Observation()
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select(F.col(value).alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    try:
        ranged.write.option("lineSep", separator).text(folder)
    except Exception:
        delete(lines.sparkSession, folder)
        raise
    return folder, seen.get["n"]


def digest(spark: SparkSession, path: str | os.PathLike) -> str:
    """SHA-256 of a file; of a folder or pattern, the root of a tree of digests.

    Each file is digested where it is read. Names below the root and digests of files meet in 4,096 groups by a hash of
    the name, and the digests of the groups, in order, give the root. How the files are dealt out doesn't matter. Files
    without bytes, which no reader sees, don't count.
    """
    if not re.search(r"[*?\[{]", str(path)) and not Files(spark).exists(path):
        raise FileNotFoundError(str(path))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri(path))
    # a single file's name stays what it is
    root = uri(path).rstrip("/")
    name = F.udf(lambda p: paths.relative(root, p), "string")(F.col("path"))
    each = files.select(name.alias("name"), F.sha2("content", 256).alias("sha"))
    told = each.limit(2).collect()
    if len(told) == 1 and told[0]["name"] == root.rpartition("/")[2]:
        return told[0]["sha"]
    return tree(each)


def tree(each: DataFrame) -> str:
    """The root over (name, sha) of files."""
    listed = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)
    group: Column = F.substring(F.sha2("name", 256), 1, 3)
    groups = each.groupBy(group.alias("g")).agg(listed(F.concat_ws(" ", "sha", "name")).alias("d"))
    return groups.agg(listed(F.concat_ws(" ", "g", "d")).alias("d")).first()["d"]
