"""The corpus pipeline: five stages over ``documents``, each on all rows the one
before it kept.

1. language: drops documents without any letter, whose language is undetermined;
2. near_duplicates: one document of each group stays, the one of the smallest id;
3. decontamination: drops documents that hold ten words of a benchmark item in a row;
4. personal_data: replaces spans of personal data by their kind;
5. encoding: adds the token ids and what they decode to.

Stages 1 to 4 return the columns of documents. A row with a null text is
undetermined and goes in stage 1; null ids are kept apart by their texts; equal
rows (id and text) are one document; further columns stay as they are, whatever
their names. Of stage 5, a new column takes the place of one that has its name.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamops.llm import byte_bpe, char_crf, dart_minhash, positional_index, rank_profiles
from streamops.llm.common import prepare, stored, table


# Columns the stages know; all others are out of their way under other names.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def keeping_columns(stage):
    """A stage that never meets the further columns of its documents by name."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"_further_{k}" for k, c in enumerate(docs.columns) if c not in KNOWN}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        taken = [c.lower() for c in out.columns]
        back = {moved: c for c, moved in aside.items() if c.lower() not in taken}
        lost = [moved for c, moved in aside.items() if c.lower() in taken]
        return out.drop(*lost).withColumnsRenamed(back)
    return run


@keeping_columns
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = rank_profiles.identify(docs, rank_profiles.learn_folds(docs))
    return found.where(F.col("lang_pred") != rank_profiles.UNKNOWN).select(*_columns(docs))


@keeping_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    groups = stored(dart_minhash.near_duplicates(docs), "near-groups")
    stay = groups.where("key is not null").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")) \
        .select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))
    keyed = dart_minhash.keyed(docs)
    kept = keyed.join(stay, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")),
                      "left_semi").dropDuplicates(["key", "doc_id"])
    return kept.select(*_columns(docs)).unionByName(docs.where("text is null"))


@keeping_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = positional_index.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("n_hit > 0").select("key").distinct()
    return dart_minhash.keyed(docs).join(bad, "key", "left_anti").select(*_columns(docs))


@keeping_columns
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = char_crf.find(docs, char_crf.train(docs), redact=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_columns(docs))


@keeping_columns
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return byte_bpe.encode_decode(docs, public_tokenizers.path(byte_bpe.RANKS),
                                  public_tokenizers.PATTERN) \
        .withColumn("decoded", F.col("decoded").cast("string"))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("personal_data", personal_data),
          ("encoding", encoding)]
ORACLE_SQL = None  # profiles, signatures and the network are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
