"""The resilient consumer: decode, skip what was handled, process, route by outcome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.constants import DEAD_LETTER_TOPIC, NO_ID, POISON, SUCCESS, TRANSIENT
from streamops.functions.codec import decode_or_poison
from streamops.operators.dedupe import first_per_id
from streamops.streaming.ledger import Ledger, SeenCache, version_of_batch, version_of_round
from streamops.streaming.sinks import BatchLog, Rounds, batch_path, empty

COMMITTED, WAITING, SKIPPED = "committed", "waiting", "skipped"
# Why a record was skipped: which tier knew its id.
BY_CACHE, BY_LEDGER = "cache", "ledger"

RECORD = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("value", T.StringType()),
])


class ResilientConsumer:
    """Handles every id of a log once, whatever is repeated, malformed or failing.

    A malformed record goes to the dead letters. A record whose id an earlier
    batch has committed is skipped: the cache knows most of these, the ledger all.
    The first remaining record of every id meets ``strategy(attempt)``: success is
    committed to the ledger and then marked in the cache, poison is parked, and a
    transient record comes back with the next batch. Further records of the id
    share its fate without being tried: they are skipped, parked, or wait.

    ``cache`` is optional, as results but for the reason of a skip are the same
    without it; ``at`` is the time a record is handled at, which a cache measures
    its retention by: an expression over the record's decoded fields, or the clock.

    A batch owns one folder with a directory per branch. The first records are
    written before their copies, which read the outcome from there, so that a
    costly strategy runs once per id, and never for one that is skipped. The decoded
    batch, its first records and what the tiers say of them are written once each, to
    folders that every batch overwrites, and read back by the steps, so that no step
    computes another one again. The manifest then names both of the batch's writes at
    once.
    """

    def __init__(self, path: str, schema: T.StructType, id_field: str,
                 strategy: Callable[[Column], Column], ledger: Ledger | None = None,
                 cache: SeenCache | None = None, at: Column | None = None):
        self.path, self.schema, self.id_field = path, schema, id_field
        self.strategy = strategy
        self.stored = T.StructType(RECORD.fields + [
            T.StructField("id", T.StringType()),
            T.StructField("attempts", T.IntegerType()),
            T.StructField("reason", T.StringType()),
            T.StructField("copies", T.LongType()),
            T.StructField("at", T.TimestampType()),
            T.StructField("branch", T.StringType()),
        ])
        self.ledger = ledger or Ledger(f"{path}-ids")
        self.cache = cache
        self.at = F.current_timestamp() if at is None else at
        self.rounds, self.out = Rounds(path), BatchLog(path)

    def _waiting(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What the batch before left waiting, unless rounds have settled it."""
        if batch_id == 0 or batch_id in self.rounds.done(spark):
            return self._next(empty(spark, self.stored))
        return self._next(self.out.last(spark, self.stored, batch_id))

    @staticmethod
    def _next(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("branch") == WAITING).select(
            *RECORD.fieldNames(), (F.col("attempts") + 1).alias("attempts")
        )

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*RECORD.fieldNames(), F.lit(1).alias("attempts")).unionByName(
            self._waiting(spark, batch_id)
        )
        written = self._handle(spark, rows, version_of_batch(batch_id),
                               batch_path(self.path, batch_id))
        self.out.commit(spark, batch_id, *written)

    def _handle(self, spark: SparkSession, rows: DataFrame, version: int, target: str) -> list[str]:
        decoded = decode_or_poison(rows, self.schema).withColumns({
            "id": F.col(self.id_field).cast("string"), "_at": self.at.cast("timestamp")})
        return self._route(spark, self._staged(decoded, "decoded"), version, target)

    def _staged(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows written once and read back, in a folder every batch overwrites."""
        folder = f"{self.path}-staged/{name}"
        rows.write.mode("overwrite").parquet(folder)
        return rows.sparkSession.read.schema(rows.schema).parquet(folder)

    def _tiers(self, spark: SparkSession, first: DataFrame, version: int) -> DataFrame:
        """``first`` with ``tier``: who knows the id already, null where nobody does."""
        asked = first.select("id", F.col("_at").alias("at"))
        if self.cache is not None:
            cached = self.cache.known(spark, version, asked).withColumn("_cached", F.lit(True))
            first = self._staged(first.join(cached, "id", "left"), "cached")
        else:
            first = first.withColumn("_cached", F.lit(None).cast("boolean"))
        known = self.ledger.known(spark, version, first.filter(F.col("_cached").isNull()).select("id"))
        tier = F.when(F.col("_cached"), BY_CACHE).when(F.col("_known"), BY_LEDGER)
        return first.join(known.withColumn("_known", F.lit(True)), "id", "left").withColumn(
            "tier", tier).drop("_cached", "_known")

    def _route(self, spark: SparkSession, decoded: DataFrame, version: int, target: str) -> list[str]:
        malformed = decoded.filter((F.col("outcome") == POISON) | F.col("id").isNull())
        good = decoded.filter((F.col("outcome") == SUCCESS) & F.col("id").isNotNull())
        good = good.drop("outcome", "error")
        first = self._staged(first_per_id(good, "id", "offset", "copies"), "first")
        first = self._staged(self._tiers(spark, first, version), "tiers")
        tried = first.filter(F.col("tier").isNull()).withColumn("_r", self.strategy(F.col("attempts")))
        branch = (
            F.when(F.col("_r.outcome") == SUCCESS, COMMITTED)
            .when(F.col("_r.outcome") == TRANSIENT, WAITING).otherwise(DEAD_LETTER_TOPIC)
        )
        kept = (*RECORD.fieldNames(), "id", "attempts")
        at = F.col("_at").alias("at")
        out = tried.select(*kept, F.col("_r.error").alias("reason"), "copies", at,
                           branch.alias("branch"))
        skipped = first.filter(F.col("tier").isNotNull()).select(
            *kept, F.col("tier").alias("reason"), "copies", at, F.lit(SKIPPED).alias("branch"))
        parked = malformed.select(*kept, F.coalesce("error", F.lit(NO_ID))
                                  .alias("reason"), F.lit(1).cast("long").alias("copies"), at,
                                  F.lit(DEAD_LETTER_TOPIC).alias("branch"))
        seen = Observation()
        all_rows = out.unionByName(skipped).unionByName(parked).observe(
            seen, F.count_if(F.col("branch") == COMMITTED).alias(COMMITTED))
        written = self._write(all_rows, target, "first")
        settled = spark.read.schema(self.stored).parquet(written)
        self._remember(spark, settled, version, seen.get[COMMITTED])
        unsettled = settled.filter(
            (F.col("copies") > 1) & F.col("branch").isin(WAITING, DEAD_LETTER_TOPIC)
        ).select("id", "branch", "reason", "copies", F.col("offset").alias("_first"),
                 F.col("attempts").alias("_tries"))
        more = good.join(unsettled, "id").filter(F.col("offset") > F.col("_first"))
        tries = F.when(F.col("branch") == WAITING, F.col("attempts") - 1).otherwise(
            F.col("_tries"))
        copies = more.withColumns({"attempts": tries, "at": F.col("_at")})
        return [written, self._write(copies.select(*self.stored.fieldNames()), target, "copies")]

    def _remember(self, spark: SparkSession, settled: DataFrame, version: int, rows: int) -> None:
        """Durable ids first, then the cache; an id the ledger knew is marked anew."""
        committed = settled.filter(F.col("branch") == COMMITTED)
        self.ledger.commit(spark, version, committed.select("id"), rows)
        if self.cache is not None:
            known = settled.filter((F.col("branch") == SKIPPED) & (F.col("reason") == BY_LEDGER))
            self.cache.mark(spark, version, committed.unionByName(known).select("id", "at"))

    def _write(self, rows: DataFrame, target: str, part: str) -> str:
        path = f"{target}/part={part}"
        rows.write.mode("overwrite").partitionBy("branch").parquet(path)
        return path

    def finish(self, spark: SparkSession, next_batch: int, most: int | None = None) -> int:
        """Retry what waits before ``next_batch`` until nothing does; see ``Rounds``."""
        def round_of(number: int) -> DataFrame:
            return spark.read.schema(self.stored).parquet(self.rounds.folder(next_batch, number))

        def attempt(number: int) -> bool:
            rows = self._waiting(spark, next_batch) if number == 0 else self._next(round_of(number - 1))
            self._handle(spark, rows, version_of_round(next_batch, number),
                         self.rounds.folder(next_batch, number))
            if not round_of(number).filter(F.col("branch") == WAITING).isEmpty():
                return True
            for tier in (self.ledger, self.cache):
                if tier is not None:
                    tier.settle(spark, next_batch, number + 1)
            return False

        return self.rounds.run(spark, next_batch, attempt, most)

    def _branch(self, spark: SparkSession, name: str) -> DataFrame:
        rows = self.out.read(spark, self.stored).unionByName(
            self.rounds.read(spark, self.stored))
        return rows.filter(F.col("branch") == name).drop("branch")

    def committed(self, spark: SparkSession) -> DataFrame:
        return self._branch(spark, COMMITTED)

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        return self._branch(spark, DEAD_LETTER_TOPIC)

    def skipped(self, spark: SparkSession) -> DataFrame:
        """Records an earlier batch had handled; ``reason`` says which tier knew."""
        return self._branch(spark, SKIPPED)
