"""Micro-batch sinks that a replayed batch leaves unchanged.

Each micro-batch owns the folder ``batch_id=N`` and overwrites it, and reads only
folders of earlier batches. Running batch N again after a crash therefore gives
the same files as running it once. What a batch has written counts once its
manifest names it, all branches at once; see ``manifest``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.constants import DEAD_LETTER_TOPIC, NO_ID, SUCCESS, TRANSIENT
from streamops.operators.dedupe import anti_ledger, first_per_id, without_id
from streamops.operators.folds import (
    CHUNK,
    cdc_changes_by_key,
    cdc_merge,
    cdc_read_model,
    running_profile,
)
from streamops.schemas import LEDGER
from streamops.streaming.ledger import Ledger, version_of_batch
from streamops.streaming.manifest import Manifest, Part

COMPACT_EVERY = 20


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_path(path, batch_id))


class BatchLog:
    """Folders of micro-batches that readers see once their manifest names them."""

    def __init__(self, path: str):
        self.path, self.manifest = path, Manifest(f"{path}-manifest")

    def write(self, rows: DataFrame, batch_id: int, *partition_by: str, part: str | None = None) -> str:
        """One of a batch's writes, not to be seen before ``commit``."""
        path = batch_path(self.path, batch_id) + (f"/part={part}" if part else "")
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return path

    def commit(self, spark: SparkSession, batch_id: int, *paths: str) -> None:
        self.manifest.commit(spark, batch_id, [Part("rows", p) for p in paths])

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Rows of all committed batches."""
        return self._rows(spark, schema, self.manifest.parts(spark))

    def last(self, spark: SparkSession, schema: T.StructType, before: int) -> DataFrame:
        """Rows of the last batch committed before ``before``."""
        return self._rows(spark, schema, self.manifest.newest(spark, before))

    def _rows(self, spark: SparkSession, schema: T.StructType, parts: list[Part]) -> DataFrame:
        if not parts:
            return empty(spark, schema)
        return spark.read.schema(schema).option("basePath", self.path).parquet(
            *[p.path for p in parts]).select(*schema.fieldNames())


class Rounds:
    """Retries after the input has ended, kept apart from the stream's batches.

    What waits before batch N is tried in rounds below ``after=N`` until nothing
    does; only then a marker makes them count. The checkpoint may later hand out
    N for new input: that batch then has nothing waiting to take over. Rounds cut
    short are repeated as a whole.
    """

    def __init__(self, path: str):
        self.root, self.marks = f"{path}-rounds", Manifest(f"{path}-rounds-done")

    def folder(self, after: int, number: int) -> str:
        return f"{self.root}/after={after}/round={number}"

    def done(self, spark: SparkSession) -> list[int]:
        return self.marks.numbers(spark)

    def mark(self, spark: SparkSession, after: int, rounds: int) -> None:
        self.marks.commit(spark, after, [
            Part("round", self.folder(after, n)) for n in range(rounds)])

    def read(self, spark: SparkSession, schema: T.StructType, until: int | None = None) -> DataFrame:
        """Rows of finished rounds, of those before batch ``until`` or all."""
        paths = [p.path for p in self.marks.parts(spark, None if until is None else until + 1)]
        if not paths:
            return empty(spark, schema)
        return spark.read.schema(schema).option("basePath", self.root).parquet(*paths).select(
            *schema.fieldNames())

    def run(self, spark: SparkSession, after: int, attempt: Callable[[int], bool],
            most: int | None = None) -> int:
        """``attempt(number)`` writes a round and says whether rows still wait;
        returns how many rounds it took. ``most`` guards against a strategy that
        never settles: beyond it an error is raised and nothing is marked."""
        if after in self.done(spark):
            return 0
        number = 0
        while attempt(number):
            number += 1
            if most is not None and number >= most:
                raise RuntimeError(f"rows still wait after {most} rounds")
        self.mark(spark, after, number + 1)
        return number + 1


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows of that schema, in a form the optimizer recognises as empty."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).select(*nulls).filter(F.lit(False))


def read_batches(spark: SparkSession, path: str, schema: T.StructType,
                 first: int, until: int) -> DataFrame:
    """Batches ``first`` up to but not including ``until``."""
    if until <= first:
        return empty(spark, schema)
    paths = [batch_path(path, n) for n in range(first, until)]
    return spark.read.schema(schema).parquet(*paths)


def read_before(spark: SparkSession, path: str, schema: T.StructType,
                batch_id: int) -> DataFrame:
    """Every batch before ``batch_id``, with its number; later folders are pruned."""
    numbered = T.StructType(schema.fields + [T.StructField("batch_id", T.IntegerType())])
    if batch_id <= 0:
        return empty(spark, numbered)
    return spark.read.schema(numbered).parquet(path).filter(F.col("batch_id") < batch_id)


class KeyedTable:
    """A table of one folded row per key, kept as one part per micro-batch.

    A batch writes only its own keys. ``merge`` folds parts into one row per key;
    it runs when the table is read, and every ``compact_every`` batches its full
    result is written instead of the batch's own part, so that a read never looks
    further back than the last such part.
    """

    def __init__(self, path: str, schema: T.StructType | None,
                 merge: Callable[[DataFrame], DataFrame], compact_every: int = COMPACT_EVERY):
        self.path, self.schema, self.merge = path, schema, merge
        self.compact_every = compact_every
        self.manifest = Manifest(f"{path}-manifest")

    def _start(self, until: int) -> int:
        return max(until - 1, 0) // self.compact_every * self.compact_every

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The table as the batches before ``batch_id`` have left it."""
        first = self._start(batch_id)
        return self.merge(read_batches(spark, self.path, self.schema, first, batch_id))

    def now(self, spark: SparkSession) -> DataFrame:
        """The table after its newest batch that is written whole."""
        newest = max(self.manifest.numbers(spark))
        if self.schema is None:
            self.schema = T.StructType(
                spark.read.parquet(batch_path(self.path, newest)).schema.fields)
        return self.before(spark, newest + 1)

    def put(self, part: DataFrame, batch_id: int) -> None:
        if batch_id > 0 and batch_id % self.compact_every == 0:
            spark = part.sparkSession
            part = self.merge(self.before(spark, batch_id).unionByName(part))
        write_batch(part, self.path, batch_id)
        self.manifest.commit(part.sparkSession, batch_id)


class BucketedTable:
    """A table of one row per key in buckets by the key's hash, copied on write.

    A batch reads and rewrites the buckets its own keys hash to; the manifest keeps
    naming the old folders of all others, whose files stay as they are. ``merge``
    folds the rows of a bucket and the batch's into one row per key; deletes are
    rows as well, with a mark, so a bucket that was written once stays. The number
    of buckets is that of Spark's shuffle partitions when the table is first
    written, unless given, and is kept from then on.
    """

    def __init__(self, path: str, schema: T.StructType, key: str,
                 merge: Callable[[DataFrame], DataFrame], buckets: int | None = None):
        self.path, self.schema, self.key, self.merge = path, schema, key, merge
        self.buckets = buckets
        self.manifest = Manifest(f"{path}-manifest")

    def _parts(self, spark: SparkSession, batch_id: int) -> tuple[int, dict[int, Part]]:
        parts = {p.level: p for p in self.manifest.newest(spark, batch_id)}
        if parts:
            return next(iter(parts.values())).depth, parts
        return self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), {}

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int").alias("bucket")

    def _touched(self, keys: DataFrame, buckets: int) -> list[int]:
        """Buckets of the keys: as many small numbers as there are buckets at most."""
        return sorted(r.bucket for r in keys.select(self._bucket(buckets)).distinct().collect())

    def _read(self, spark: SparkSession, parts: list[Part]) -> DataFrame:
        if not parts:
            return empty(spark, self.schema)
        return spark.read.schema(self.schema).parquet(*[p.path for p in parts])

    def before(self, spark: SparkSession, batch_id: int, keys: DataFrame | None = None) -> DataFrame:
        """The table as the batches before ``batch_id`` have left it; with ``keys`` only
        the buckets these are in."""
        buckets, parts = self._parts(spark, batch_id)
        if keys is not None and parts:
            parts = {b: parts[b] for b in self._touched(keys, buckets) if b in parts}
        return self._read(spark, list(parts.values()))

    def now(self, spark: SparkSession) -> DataFrame:
        return self.before(spark, max(self.manifest.numbers(spark), default=-1) + 1)

    def put(self, part: DataFrame, batch_id: int) -> list[int]:
        """Fold a batch's rows in; returns the buckets written."""
        spark = part.sparkSession
        buckets, parts = self._parts(spark, batch_id)
        touched = self._touched(part, buckets)
        if touched:
            old = self._read(spark, [parts[b] for b in touched if b in parts])
            rows = self.merge(old.unionByName(part.select(*self.schema.fieldNames())))
            folder = batch_path(self.path, batch_id)
            rows.withColumn("bucket", self._bucket(buckets)).repartition("bucket").write.mode(
                "overwrite").partitionBy("bucket").parquet(folder)
            parts |= {b: Part("bucket", f"{folder}/bucket={b}", b, buckets) for b in touched}
        self.manifest.commit(spark, batch_id, parts.values())
        return touched


# --- read model -----------------------------------------------------------

CDC_PART = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("upsert_at", T.LongType()),
    T.StructField("changed_at", T.LongType()),
])


class ReadModel:
    """Customer index with soft delete, fed by changes in micro-batches."""

    def __init__(self, path: str, order: str = "offset", buckets: int | None = None):
        self.order = order
        self.table = BucketedTable(path, CDC_PART, "customer_id", cdc_merge, buckets)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        part = cdc_changes_by_key(batch, self.order)
        typed = part.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CDC_PART])
        self.table.put(typed, batch_id)

    def read(self, spark: SparkSession, batches: int | None = None) -> DataFrame:
        """The model after the first ``batches`` micro-batches, or after all."""
        parts = self.table.now(spark) if batches is None else self.table.before(spark, batches)
        return cdc_read_model(parts)


# --- profiles, one row per event ------------------------------------------

PROFILE_PART = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("event_count", T.LongType()),
])


def _sum_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id").agg(F.sum("event_count").alias("event_count"))


class ProfileFold:
    """A derived profile for every event of a stream, under the event's own key.

    Inside a batch the running count comes from ``running_profile``, which splits
    hot users; earlier batches contribute one count per user, kept by buckets of
    which a batch reads and rewrites those of its own users.
    """

    def __init__(self, out: str, state: str, chunk: int = CHUNK, buckets: int | None = None):
        self.out, self.chunk = out, chunk
        self.table = BucketedTable(state, PROFILE_PART, "user_id", _sum_counts, buckets)

    def derive(self, batch: DataFrame, batch_id: int) -> None:
        earlier = self.table.before(batch.sparkSession, batch_id, batch)
        write_batch(running_profile(batch, self.chunk, earlier), self.out, batch_id)
        counts = batch.groupBy("user_id").agg(F.count("*").alias("event_count"))
        self.table.put(counts, batch_id)


# --- materialized aggregate -----------------------------------------------


class MaterializedTable:
    """The newest row per key of an aggregate that a stream keeps updating."""

    def __init__(self, path: str, *key: str, compact_every: int = COMPACT_EVERY):
        self.key = list(key)
        self.table = KeyedTable(path, None, self._newest, compact_every)

    def _newest(self, parts: DataFrame) -> DataFrame:
        keys = {c.lower() for c in self.key}
        values = [c for c in parts.columns if c.lower() not in keys]
        row = F.max_by(F.struct(*values), F.col("version")).alias("_row")
        return parts.groupBy(*self.key).agg(row).select(*self.key, "_row.*")

    def put(self, batch: DataFrame, batch_id: int) -> None:
        part = batch.withColumn("version", F.lit(batch_id).cast("long"))
        part = part.select(*self.key, *[c for c in part.columns
                                        if c.lower() not in {k.lower() for k in self.key}])
        self.table.schema = part.schema
        self.table.put(part, batch_id)

    def pull(self, spark: SparkSession) -> DataFrame:
        """Point-in-time read of the whole table."""
        return self.table.now(spark).drop("version")


# --- ledger ---------------------------------------------------------------


_LEDGER_ROWS = T.StructType(LEDGER.fields + [T.StructField("branch", T.StringType())])


class LedgerSink:
    """Process every id once: earlier batches' ids are the ledger.

    A record without an id cannot be told from others: it is parked with a reason,
    in the same write. ``seed`` is a ledger that exists before the first batch.
    """

    def __init__(self, path: str, key: str, order: str, payload: str,
                 seed: DataFrame | None = None, ledger: Ledger | None = None):
        self.path, self.key, self.order, self.payload = path, key, order, payload
        self.seed = seed
        self.out = BatchLog(path)
        self.ledger = ledger or Ledger(f"{path}-ids")

    def commit(self, batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, version_of_batch(batch_id)
        # Written once and read back by the steps, in a folder every batch overwrites.
        first = first_per_id(batch.select(*dict.fromkeys((self.key, self.order, self.payload))),
                             self.key, self.order)
        folder = f"{self.path}-staged/first"
        first.write.mode("overwrite").parquet(folder)
        first = spark.read.schema(first.schema).parquet(folder)
        known = self.ledger.known(spark, version, first.select(F.col(self.key).cast("string").alias("id")))
        fresh = anti_ledger(first, known, self.key, "id")
        if self.seed is not None:
            fresh = anti_ledger(fresh, self.seed, self.key)
        branches = [
            rows.select(F.col(self.key).alias("transaction_id"),
                        F.current_timestamp().alias("processed_on"),
                        F.col(self.payload).alias("payload"), F.lit(branch).alias("branch"))
            for rows, branch in ((fresh, "committed"),
                                 (without_id(batch, self.key), DEAD_LETTER_TOPIC))
        ]
        seen = Observation()
        rows = branches[0].unionByName(branches[1]).observe(
            seen, F.count_if(F.col("branch") == "committed").alias("rows"))
        path = self.out.write(rows, batch_id, "branch")
        written = spark.read.schema(_LEDGER_ROWS).parquet(path).filter(F.col("branch") == "committed")
        self.ledger.commit(spark, version, written.select(F.col("transaction_id").alias("id")), seen.get["rows"])
        self.out.commit(spark, batch_id, path)

    def _branch(self, spark: SparkSession, name: str) -> DataFrame:
        return self.out.read(spark, _LEDGER_ROWS).filter(F.col("branch") == name)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._branch(spark, "committed").drop("branch")

    def parked(self, spark: SparkSession) -> DataFrame:
        """Records without an id: payload and reason."""
        return self._branch(spark, DEAD_LETTER_TOPIC).select(
            "payload", F.lit(NO_ID).alias("reason"))


# --- main output, dead letters and retries --------------------------------


_DELIVERED = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("reason", T.StringType()),
    T.StructField("branch", T.StringType()),
])


class DeliverySink:
    """Delivered records and parked ones, written from one pass over the batch.

    Both branches are directories of a single write, so they commit together and
    a failed write of either fails, and replays, the batch.
    """

    def __init__(self, path: str, key: str, value: Column):
        self.path, self.key, self.value = path, key, value
        self.out = BatchLog(path)

    def deliver(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.col(self.key).cast("string").alias("key"),
            self.value.cast("string").alias("value"),
            F.col("attempts").cast("int").alias("attempts"),
            F.col("error").alias("reason"),
            F.when(F.col("outcome") == SUCCESS, "delivered")
            .otherwise(DEAD_LETTER_TOPIC).alias("branch"),
        )
        self.out.commit(batch.sparkSession, batch_id, self.out.write(rows, batch_id, "branch"))

    def _branch(self, spark: SparkSession, name: str) -> DataFrame:
        return self.out.read(spark, _DELIVERED).filter(F.col("branch") == name)

    def delivered(self, spark: SparkSession) -> DataFrame:
        return self._branch(spark, "delivered").select("key", "value", "attempts")

    def dead_letter_monitor(self, spark: SparkSession) -> DataFrame:
        """Parked rows: key, attempts and reason, blank where there is none."""
        return self._branch(spark, DEAD_LETTER_TOPIC).select(
            "key", "value", "attempts", F.coalesce("reason", F.lit("")).alias("reason")
        )


class RetrySink:
    """Transient rows re-enter with the next batch until they settle.

    ``strategy(attempt)`` gives the result of a try as ``struct<outcome,error>``.
    Settled and waiting rows are directories of a single write per batch.
    """

    def __init__(self, path: str, schema: T.StructType, strategy: Callable[[Column], Column]):
        self.path, self.schema, self.strategy = path, schema, strategy
        self.waiting_schema = T.StructType(schema.fields + [
            T.StructField("attempt", T.IntegerType()),
            T.StructField("branch", T.StringType()),
        ])

        self.rounds, self.out = Rounds(path), BatchLog(path)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("attempt", F.lit(1)).unionByName(
            self._again(batch.sparkSession, batch_id))
        path = batch_path(self.path, batch_id)
        self._try(rows, path)
        self.out.commit(batch.sparkSession, batch_id, path)

    def _again(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What the batch before left waiting, unless rounds have settled it."""
        if batch_id in self.rounds.done(spark):
            return self._next(empty(spark, self.waiting_schema))
        return self._next(read_batches(spark, self.path, self.waiting_schema,
                                       max(batch_id - 1, 0), batch_id))

    @staticmethod
    def _next(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("branch") == "waiting").drop("branch").withColumn(
            "attempt", F.col("attempt") + 1)

    def _try(self, rows: DataFrame, path: str) -> None:
        tried = rows.withColumn("_r", self.strategy(F.col("attempt"))).select(
            *rows.columns, F.col("_r.outcome"), F.col("_r.error")
        )
        branch = F.when(F.col("outcome") == TRANSIENT, "waiting").otherwise("settled")
        tried.withColumn("branch", branch).write.mode("overwrite").partitionBy(
            "branch"
        ).parquet(path)

    def finish(self, spark: SparkSession, next_batch: int, most: int | None = None) -> int:
        """Retry what waits before ``next_batch`` until nothing does; see ``Rounds``."""
        def attempt(number: int) -> bool:
            if number == 0:
                rows = self._again(spark, next_batch)
            else:
                rows = self._next(spark.read.schema(self.waiting_schema).parquet(
                    self.rounds.folder(next_batch, number - 1)))
            target = self.rounds.folder(next_batch, number)
            self._try(rows, target)
            left = spark.read.schema(self.waiting_schema).parquet(target)
            return not left.filter(F.col("branch") == "waiting").isEmpty()

        return self.rounds.run(spark, next_batch, attempt, most)

    def settled(self, spark: SparkSession) -> DataFrame:
        tried = T.StructType(self.waiting_schema.fields[:-1] + [
            T.StructField("outcome", T.StringType()), T.StructField("error", T.StringType()),
            self.waiting_schema.fields[-1]])
        rows = self.out.read(spark, tried).unionByName(
            self.rounds.read(spark, tried))
        return rows.filter(F.col("branch") == "settled").drop("branch")

    def waiting(self, spark: SparkSession, batches: int) -> DataFrame:
        """Rows still transient after the first ``batches`` batches and the rounds
        that followed them."""
        if batches in self.rounds.done(spark):
            return empty(spark, self.waiting_schema).drop("branch")
        rows = read_batches(spark, self.path, self.waiting_schema, batches - 1, batches)
        return rows.filter(F.col("branch") == "waiting").drop("branch")
