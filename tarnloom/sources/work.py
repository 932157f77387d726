"""Folders for work tables and for tables that change a part at a time."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir (in local mode, where that is unset, in
    one of our own); the JVM deletes it when it ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tarnloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    target, fs = folder(spark, path)
    fs.deleteOnExit(target)
    return path


def folder(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    target, fs = folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


class Parts:
    """A table below path as a list of parts. Which parts are live stands in the newest of numbered list files: a change
    writes its part first, then the list that names it, so a reader sees the table before the change or after it, and
    what a crash leaves behind is in no list. The parts of the list before stay until the next change, for readers that
    have begun. One writer at a time; a second one that began from the same list fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def live(self) -> tuple[int, list[str]]:
        """The newest list's number (0: there is none) and its parts, oldest first."""
        lists = [n for n in names_in(self.spark, self.path) if n.startswith("_list-")]
        if not lists:
            return 0, []
        target, fs = folder(self.spark, f"{self.path}/{lists[-1]}")
        stream = fs.open(target)
        try:
            names = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()
        return int(lists[-1].removeprefix("_list-")), [f"{self.path}/{n}" for n in names]

    def fresh(self) -> str:
        return f"{self.path}/part-{uuid.uuid4().hex}"

    def commit(self, number: int, parts: list[str]) -> None:
        """Makes parts the live ones, if list `number` still is the newest; then deletes what neither list names."""
        _, before = self.live()
        target, fs = folder(self.spark, f"{self.path}/_list-{number + 1:012d}")
        draft, _ = folder(self.spark, f"{self.path}/_draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray("\n".join(p.rsplit("/", 1)[1] for p in parts), "utf-8"))
        stream.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise OSError(f"another writer has changed {self.path}")
        needed = {p.rsplit("/", 1)[1] for p in [*before, *parts]} | {f"_list-{number + k:012d}" for k in (0, 1)}
        for name in names_in(self.spark, self.path):
            if name not in needed and not name.endswith(".crc"):
                fs.delete(folder(self.spark, f"{self.path}/{name}")[0], True)
