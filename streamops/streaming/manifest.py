"""Atomic commits of whatever a batch has written, without touching the file system.

A batch writes as many folders as it needs and then, as the last thing, one small
file that names them. Readers go by these files alone: a batch cut short between
two of its writes has left nothing that anyone reads, and its replay overwrites
what is there. The file appears by one rename, that of its single task's output.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Manifests lie in folders of so many, so that finding the newest reads few.
BLOCK = 100


class Part(NamedTuple):
    """A folder that a batch has written. ``level``, ``depth`` and ``hour`` are for
    the structures that keep their parts in a manifest."""

    kind: str
    path: str
    level: int = 0
    depth: int = 0
    hour: int = 0
    rows: int = 0


SCHEMA = "kind string, path string, level int, depth int, hour long, rows long"
PLACED = f"{SCHEMA}, block long, number long"


class Manifest:
    def __init__(self, path: str, block: int = BLOCK):
        self.path, self.block = path, block
        self._asked: tuple[int, list[Part]] | None = None
        self._made: set[int] = set()

    def _folder(self, number: int) -> str:
        return f"{self.path}/block={number // self.block}/number={number}"

    def commit(self, spark: SparkSession, number: int, parts: Iterable[Part] = ()) -> None:
        """Make ``parts`` all that batch ``number`` has written; again is the same as once."""
        self._asked = None
        rows = list(parts) or [Part("none", "")]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            self._folder(number))

    def _read(self, spark: SparkSession, block: int | None = None) -> DataFrame:
        """The manifests of one block, or all. A folder that may be missing is made by a
        manifest without a number of a batch, which is written only where it is not
        there yet."""
        at = block or 0
        if at not in self._made:
            spark.createDataFrame([Part("none", "")], SCHEMA).coalesce(1).write.mode("ignore").parquet(
                f"{self.path}/block={at}/number=-1")
            self._made.add(at)
        path = self.path if block is None else f"{self.path}/block={block}"
        return spark.read.schema(PLACED).option("basePath", self.path).parquet(path).filter("number >= 0")

    def newest(self, spark: SparkSession, before: int) -> list[Part]:
        """What the last batch before ``before`` has committed; none without one.
        Asked again before the next commit, the answer is the same."""
        if self._asked is None or self._asked[0] != before:
            self._asked = before, self._newest(spark, before)
        return list(self._asked[1])

    def _newest(self, spark: SparkSession, before: int) -> list[Part]:
        for block in range((before - 1) // self.block, -1, -1):
            found = self._read(spark, block).filter(F.col("number") < before).collect()
            if found:
                last = max(r.number for r in found)
                return sorted((Part(*r[:len(Part._fields)]) for r in found
                               if r.number == last and r.kind != "none"), key=lambda p: p.path)
        return []

    def numbers(self, spark: SparkSession) -> list[int]:
        return sorted(r.number for r in self._read(spark).select("number").distinct().collect())

    def parts(self, spark: SparkSession, until: int | None = None) -> list[Part]:
        """Everything committed, or by batches before ``until``."""
        rows = self._read(spark)
        return _parts(rows if until is None else rows.filter(F.col("number") < until))


def _parts(rows: DataFrame) -> list[Part]:
    return [Part(*r) for r in rows.filter(F.col("kind") != "none").select(*Part._fields)
            .orderBy("path").collect()]
