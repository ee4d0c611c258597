"""The ids a consumer has handled: for ever in a ledger, for a day in a cache.

The ledger is kept in runs. A batch adds one run; ``fan`` runs of a level are
merged into one of the next, so there are few runs however old the ledger is, and
an id is rewritten once per level. A run lies in folders by the low bits of the
id's hash, as many as keep a folder at about ``bucket_rows`` ids: a batch reads
the folders its own ids hash to and nothing else, so what it reads follows the
batch and not the ledger.

The cache holds ids by the hour they were marked in. Hours that have expired are
not read, and drop out of the manifest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamops.constants import DEDUP_RETENTION_HOURS
from streamops.streaming.manifest import Manifest, Part

BUCKET_ROWS = 200_000
FAN = 8
MAX_DEPTH = 16
# Versions of a ledger leave room for rounds of retries between two batches.
VERSIONS = 1_000_000

_IDS = "id string"
_BUCKETED = "id string, bucket int"
_MARKS = "id string, marked_at timestamp"


def version_of_batch(batch_id: int) -> int:
    return (batch_id + 1) * VERSIONS - 1


def version_of_round(after: int, number: int) -> int:
    """Rounds before batch ``after`` lie between the batch before it and that one."""
    if number >= VERSIONS - 2:
        raise ValueError("too many rounds")
    return after * VERSIONS + number


def bucket(id_: str | Column, depth: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(1 << depth)).cast("int")


def no_ids(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit(None).cast("string").alias("id"))


class _Versions:
    """What is kept by version: a state per batch or round, the newest of which counts."""

    manifest: Manifest

    def settle(self, spark: SparkSession, after: int, rounds: int) -> None:
        """End the rounds before batch ``after``: what ``rounds`` of them left counts,
        and not what an attempt cut short may have left of further ones."""
        parts = self.manifest.newest(spark, version_of_round(after, rounds))
        self.manifest.commit(spark, version_of_batch(after) - 1, parts)


class Ledger(_Versions):
    """Which ids were committed, by version. Committing a version again replaces it,
    and a version reads only older ones, so replays see what the first run saw."""

    def __init__(self, path: str, bucket_rows: int = BUCKET_ROWS, fan: int = FAN):
        self.path, self.bucket_rows, self.fan = path, bucket_rows, fan
        self.manifest = Manifest(f"{path}/manifest", VERSIONS * 100)

    def runs(self, spark: SparkSession, version: int) -> list[Part]:
        """The runs that hold what was committed before ``version``."""
        return self.manifest.newest(spark, version)

    def known(self, spark: SparkSession, version: int, ids: DataFrame) -> DataFrame:
        """Those of the distinct ``ids`` (a column ``id``) that the ledger holds."""
        runs = self.runs(spark, version)
        if not runs:
            return no_ids(spark)
        deepest = max(r.depth for r in runs)
        # At most 2^MAX_DEPTH small numbers come to the driver.
        touched = [0] if deepest == 0 else sorted(
            r[0] for r in ids.select(bucket("id", deepest)).distinct().collect())
        if not touched:
            return no_ids(spark)
        held = None
        for run in runs:
            rows = self._read(spark, run, sorted({t % (1 << run.depth) for t in touched}))
            held = rows if held is None else held.unionByName(rows)
        # Small batches are broadcast to the folders read; those are never shuffled then.
        return held.select("id").join(ids.select("id"), "id", "left_semi").distinct()

    @staticmethod
    def _read(spark: SparkSession, run: Part, buckets: list[int] | None = None) -> DataFrame:
        """A run's ids, of the given buckets only; every bucket has a folder."""
        reader = spark.read.schema(_BUCKETED).option("basePath", run.path)
        if buckets is None or len(buckets) == 1 << run.depth:
            rows = reader.parquet(run.path)
        else:
            rows = reader.parquet(*[f"{run.path}/bucket={b}" for b in buckets])
        return rows.filter(F.col("id").isNotNull()).select("id")

    def commit(self, spark: SparkSession, version: int, ids: DataFrame,
               rows: int | None = None) -> list[Part]:
        """Add ``ids``, of which there are ``rows`` if the caller knows; returns the runs
        from now on. Merges what has become many."""
        runs = self.runs(spark, version)
        found = ids.select("id").filter(F.col("id").isNotNull())
        rows = found.count() if rows is None else rows
        if rows:
            runs = [*runs, self._write(spark, found, f"{self.path}/run={version}-0", 0, rows)]
        level = 0
        while sum(r.level == level for r in runs) >= self.fan:
            old = [r for r in runs if r.level == level]
            merged = None
            for run in old:
                rows = self._read(spark, run)
                merged = rows if merged is None else merged.unionByName(rows)
            level += 1
            runs = [r for r in runs if r not in old] + [
                self._write(spark, merged, f"{self.path}/run={version}-{level}", level,
                            sum(r.rows for r in old))]
        self.manifest.commit(spark, version, runs)
        return runs

    def _write(self, spark: SparkSession, ids: DataFrame, path: str, level: int, rows: int) -> Part:
        depth = min(max((rows - 1) // self.bucket_rows, 0).bit_length(), MAX_DEPTH)
        placed = ids.select("id", bucket("id", depth).alias("bucket"))
        if depth:
            # A row without an id gives every bucket its folder.
            folders = spark.range(1 << depth).select(
                F.lit(None).cast("string").alias("id"), F.col("id").cast("int").alias("bucket"))
            placed = placed.unionByName(folders).repartition("bucket")
        else:
            placed = placed.coalesce(1)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return Part("run", path, level, depth, 0, rows)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """All ids, or those committed before ``version``."""
        before = version if version is not None else max(self.manifest.numbers(spark), default=0) + 1
        out = no_ids(spark)
        for run in self.runs(spark, before):
            out = out.unionByName(self._read(spark, run))
        return out


class SeenCache(_Versions):
    """Ids marked within the retention time: a fast path in front of the ledger.

    A cache that cannot be reached says "not seen" and marks nothing; the ledger
    is the guarantee. ``unreachable`` counts how often that was so.
    """

    def __init__(self, path: str, hours: float = DEDUP_RETENTION_HOURS, fan: int = FAN):
        self.path, self.hours, self.fan = path, hours, fan
        self.manifest = Manifest(f"{path}/manifest", VERSIONS * 100)
        self.unreachable = 0

    def _expired(self, hour: int, at: float) -> bool:
        """Whether no mark of that hour can count at ``at``, in seconds."""
        return (hour + 1) * 3600 <= at - self.hours * 3600

    def known(self, spark: SparkSession, version: int, rows: DataFrame) -> DataFrame:
        """Distinct ids of ``rows`` (id, at) with a mark less than the retention time old."""
        try:
            parts = self.manifest.newest(spark, version)
            earliest = rows.agg(F.min(F.unix_micros("at"))).first()[0] if parts else None
            if earliest is None:
                return no_ids(spark)
            live = [p.path for p in parts if not self._expired(p.hour, earliest / 1e6)]
            if not live:
                return no_ids(spark)
            marks = spark.read.schema(_MARKS).parquet(*live)
        except AnalysisException:
            self.unreachable += 1
            return no_ids(spark)
        asked = rows.select("id", "at")
        fresh = F.col("marked_at") > F.col("at") - F.expr(f"INTERVAL {round(self.hours * 3600)} SECONDS")
        return marks.join(asked, "id").filter(fresh).select("id").distinct()

    def mark(self, spark: SparkSession, version: int, rows: DataFrame) -> None:
        """Remember ``rows`` (id, at) from now on, in one folder per hour."""
        try:
            self._mark(spark, version, rows)
        except AnalysisException:
            self.unreachable += 1

    def _mark(self, spark: SparkSession, version: int, rows: DataFrame) -> None:
        parts = self.manifest.newest(spark, version)
        path = f"{self.path}/marks={version}"
        hour = F.expr("unix_seconds(at) div 3600").alias("hour")
        spread = rows.groupBy(hour).agg(F.max(F.unix_micros("at")).alias("newest")).collect()
        newest = max((r.newest for r in spread if r.newest is not None), default=0)
        # What has expired by the time of the newest mark need not be written.
        hours = [r.hour for r in spread if r.hour is not None and not self._expired(r.hour, newest / 1e6)]
        if hours:
            rows.select("id", F.col("at").alias("marked_at"), hour).filter(F.col("hour") >= min(hours)) \
                .hint("rebalance", "hour").write.mode("overwrite").partitionBy("hour").parquet(path)
        parts += [Part("marks", f"{path}/hour={h}", 0, 0, h) for h in hours]
        if hours:
            parts = [p for p in parts if not self._expired(p.hour, newest / 1e6)]
        parts = [q for h in sorted({p.hour for p in parts})
                 for q in self._merged(spark, version, h, [p for p in parts if p.hour == h])]
        self.manifest.commit(spark, version, parts)

    def _merged(self, spark: SparkSession, version: int, hour: int, parts: list[Part]) -> list[Part]:
        """An hour's parts, as one where they have become many."""
        if len(parts) < self.fan:
            return parts
        path = f"{self.path}/merged={version}/hour={hour}"
        # In files of a bounded size, each by a task of its own: an hour may be a hot one.
        spark.read.schema(_MARKS).parquet(*[p.path for p in parts]).hint("rebalance").write.mode(
            "overwrite").parquet(path)
        return [Part("marks", path, 1, 0, hour)]
