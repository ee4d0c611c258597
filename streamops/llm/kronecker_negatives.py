"""Hard negatives by exact inner products over Kronecker-packed integers.

Component j of all candidates of a chunk stands in one wide integer, each biased
to be no less than zero and in a field of its own that no sum can outgrow. An
anchor then multiplies that integer once by its own component j; the sum over
the components holds every candidate's score in its field. Anchors and
candidates meet in cells of bounded size, a chunk of candidates with a block of
anchors, so nothing is gathered and each product is computed once.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamops.llm.common import stored

# Bytes of components in a chunk of candidates and in a block of anchors.
CELL_BYTES = 8 << 20
POSITIVES = NEGATIVES = 5
# A negative scores at least this share of the positive, in hundredths, and at most all of it.
LEAST_SHARE = 80


def participants(vectors: DataFrame, item: str, label: str, vector: str) -> DataFrame:
    """(vec_id, label, row, dim, v): rows that take part, components as integers;
    ``row`` deals them out evenly even where one id is everywhere."""
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(
        F.col(item).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("raw"),
        F.monotonically_increasing_id().alias("row")) \
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull()) \
        .withColumn("raw", F.col("raw").cast("array<double>")).where(finite) \
        .select("vec_id", "label", "row", F.size("raw").alias("dim"),
                F.transform("raw", lambda x: F.floor(256 * x)).alias("v"))


class Fields:
    """How wide a field has to be: from the components' bound and their number."""

    def __init__(self, bound: int, dim: int):
        self.bound = bound
        most = dim * (2 * bound) ** 2
        if most >= 1 << 62:
            raise ValueError("components are so large that scores do not fit a long")
        self.width, self.kind = (4, "<u4") if most < 1 << 32 else (8, "<u8")

    def pack(self, rows: np.ndarray) -> list[int]:
        """One wide integer per component, holding that of all rows."""
        biased = np.ascontiguousarray((rows + self.bound).T.astype(self.kind))
        return [int.from_bytes(one.tobytes(), "little") for one in biased]

    def scores(self, anchor: np.ndarray, packed: list[int], sums: np.ndarray) -> np.ndarray:
        """The anchor's inner product with every packed row."""
        biased = [int(x) + self.bound for x in anchor]
        total = sum(map(mul, biased, packed))
        field = np.frombuffer(total.to_bytes(self.width * len(sums), "little"), self.kind)
        # (a + m)(c + m) summed up, less what the bias has added.
        extra = self.bound * int(anchor.sum()) + len(anchor) * self.bound**2
        return field.astype(np.int64) - self.bound * sums - extra


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    values = column.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def best(scores: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Of the rows ``among`` (ascending, as their ids are) those of the highest
    scores, ties by the earlier row."""
    own = scores[among]
    if len(own) > most:
        least = np.partition(own, len(own) - most)[len(own) - most]
        among = among[own >= least]
    return among[np.argsort(-scores[among], kind="stable")[:most]]


class _Cell:
    """A chunk of candidates, ordered by id and packed."""

    def __init__(self, table: pa.Table, fields: Fields):
        rows = _matrix(table.column("v"), table.num_rows)
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        self.labels = np.asarray(table.column("label"), object)[order]
        self.fields, self.packed, self.sums = fields, fields.pack(rows), rows.sum(axis=1)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        if not len(anchor):
            return np.zeros(len(self.ids), np.int64)
        return self.fields.scores(anchor, self.packed, self.sums)


_FOUND = "anchor_id long, anchor_row long, {0}other_id long, score long"


def _positives(fields: Fields, most: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            candidates = _Cell(left, fields)
            anchors = _matrix(right.column("v"), right.num_rows)
            for anchor, vec_id, row in zip(anchors, right.column("vec_id").to_pylist(),
                                           right.column("row").to_pylist()):
                scores = candidates.scores(anchor)
                for at in best(scores, np.flatnonzero(candidates.ids != vec_id), most).tolist():
                    for column, x in zip(out, (vec_id, row, candidates.ids[at], scores[at])):
                        column.append(x)
        return pa.table([pa.array(c, pa.int64()) for c in out],
                        names=["anchor_id", "anchor_row", "other_id", "score"])
    return cell


def _negatives(fields: Fields, most: int, share: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            candidates = _Cell(left, fields)
            anchors = _matrix(right.column("v"), right.num_rows)
            for k, anchor in enumerate(anchors):
                vec_id, row, label, limits = (right.column(c)[k].as_py()
                                              for c in ("vec_id", "row", "label", "limits"))
                scores = candidates.scores(anchor)
                other = (candidates.labels != label) & (candidates.ids != vec_id)
                for limit in limits:
                    fits = other & (scores <= limit) & (scores >= -(-share * limit // 100))
                    for at in best(scores, np.flatnonzero(fits), most).tolist():
                        for column, x in zip(out, (vec_id, row, limit, candidates.ids[at], scores[at])):
                            column.append(x)
        return pa.table([pa.array(c, pa.int64()) for c in out],
                        names=["anchor_id", "anchor_row", "positive_score", "other_id", "score"])
    return cell


def _cells(rows: DataFrame, anchors: DataFrame, sizes: DataFrame, group: list[str], size: int,
           cell, schema: str) -> DataFrame:
    """What ``cell`` gives for every chunk of a group's rows with every block of its anchors.

    ``sizes`` has a group's number of rows ``n`` and of anchors ``a``.
    """
    parts = sizes.where("a > 0").select(
        *group, F.ceil(F.col("n") / size).cast("int").alias("chunks"),
        F.ceil(F.col("a") / size).cast("int").alias("blocks"))

    def dealt(df: DataFrame, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
        at = F.pmod(F.xxhash64("row"), F.col(own_count)).cast("int")
        return df.join(parts, group).withColumn(own, at).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1))).drop("chunks", "blocks")

    keys = [*group, "chunk", "block"]
    left = dealt(rows, "chunk", "chunks", "block", "blocks")
    right = dealt(anchors, "block", "blocks", "chunk", "chunks")
    right = right.toDF(*right.columns)  # columns of its own: both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def mine(vectors: DataFrame, is_anchor: Column, item: str = "vec_id", label: str = "label",
         vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
         share: int = LEAST_SHARE, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row takes part if its id and label are not null and all components of its
    vector are finite; ``is_anchor`` is a condition on ``vec_id`` and ``label``.
    An anchor meets rows with as many components as it has, others are not
    comparable; vectors without components score 0. Rows under the anchor's own
    id are no others; a repeated row counts as often as it is there, anchors equal
    in id, label and vector are one anchor. Ties go to the smaller id. Further
    columns are not read, whatever their names. An empty table, or no anchor with
    a positive, gives no rows. Components whose scores could leave a long raise
    an error.
    """
    rows = participants(vectors, item, label, vector)
    anchors = rows.where(is_anchor).select("vec_id", "label", "dim", "v").distinct() \
        .withColumn("row", F.xxhash64("vec_id", "label", "v"))
    sizes = stored(rows.groupBy("dim", "label").agg(
        F.count("*").alias("n"), F.count_if(is_anchor).alias("a"),
        F.max(F.array_max(F.transform("v", F.abs))).alias("bound")), "negatives-sizes")
    bound, dim = sizes.agg(F.max("bound"), F.max("dim")).first()
    fields = Fields(int(bound or 0), int(dim or 0))
    size = max(1, cell_bytes // (8 * max(1, int(dim or 0))))

    same = _cells(rows, anchors, sizes, ["dim", "label"], size, _positives(fields, positives),
                  _FOUND.format(""))
    near = stored(_first(same, ["anchor_id", "anchor_row"], positives).select(
        "anchor_id", "anchor_row", F.col("other_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "negatives-positives")

    limits = near.groupBy(F.col("anchor_row").alias("row"), F.col("anchor_id").alias("vec_id")).agg(
        F.array_sort(F.collect_set("positive_score")).alias("limits"))
    asking = anchors.join(limits, ["row", "vec_id"])
    by_dim = sizes.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    apart = _cells(rows, asking, by_dim, ["dim"], size, _negatives(fields, negatives, share),
                   _FOUND.format("positive_score long, "))
    ranked = _first(apart, ["anchor_id", "anchor_row", "positive_score"], negatives)
    return near.join(ranked, ["anchor_id", "anchor_row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
