"""Folders read a part at a time: each file once for each time that it changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.catalog import new_manifest_rows
from .files import listing, manifest_lines, write_manifest

SEEN = "path string, length long, modificationTime timestamp"


class Seen:
    """What of a folder has been read: a table of paths, lengths and times of change below a folder of its own, added to by each run that went well."""

    def __init__(self, spark: SparkSession, state: str) -> None:
        self.spark, self.state = spark, state

    def table(self) -> DataFrame:
        """Of each path, what was read last."""
        try:
            rows = self.spark.read.schema(SEEN).parquet(self.state)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SEEN)
        newest = Window.partitionBy("path").orderBy(F.desc("modificationTime"), F.desc("length"))
        return rows.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k")

    def new(self, folder: str, pattern: str | None = None) -> DataFrame:
        """Files below a folder that haven't been read as they are now: unknown paths, and those whose time of change or length is another. Contents aren't read; in order of paths."""
        found = listing(self.spark, folder, pattern)
        known = self.table()
        same = ["path", "length", "modificationTime"]
        return found.join(known, same, "left_anti").orderBy("path")

    def mark(self, files: DataFrame) -> None:
        """Says that these files have been read as they were listed."""
        files.select("path", "length", "modificationTime").write.mode("append").parquet(self.state)

    def run(self, folder: str, work: Callable[[list[str]], None], pattern: str | None = None, at_once: int = 10_000) -> int:
        """Hands new files' paths to ``work``, some at a time, and marks them once it returns: what it raised over comes again in the next run. Returns how many there were.

        A file that changes after it was listed comes again, as its time of change is then another one.
        """
        done = 0
        while some := self.new(folder, pattern).select("path", "length", "modificationTime").limit(at_once).collect():
            work([r["path"] for r in some])
            self.mark(self.spark.createDataFrame(some, SEEN))
            done += len(some)
        return done


def grown_manifest(spark: SparkSession, folder: str, manifest: str, state: str, pattern: str = "*.png") -> int:
    """Adds the images below a folder that are new to a manifest; each path once, however often its file changes."""
    def add(paths: list[str]) -> None:
        images = spark.createDataFrame([(p,) for p in paths], "image string")
        try:
            there = manifest_lines(spark.read.text(manifest))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = images.limit(0)
        write_manifest(new_manifest_rows(there, images), manifest)

    return Seen(spark, state).run(folder, add, pattern)
