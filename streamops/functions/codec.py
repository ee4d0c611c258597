"""Decoding of JSON values and of record headers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamops.constants import DECODE_FAILED, POISON, SUCCESS
from streamops.schemas import HEADERS

_CORRUPT = "_corrupt"


def _parse(column: str, schema: T.StructType) -> Column:
    """Struct of ``schema`` plus the raw text wherever that text is malformed."""
    with_corrupt = T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())])
    return F.from_json(
        F.col(column), with_corrupt,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
    )


def decode_json(df: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Replace a JSON column by the fields of ``schema``."""
    return (
        df.withColumn("_decoded", F.from_json(F.col(column), schema))
        .select(*[c for c in df.columns if c != column], "_decoded.*")
    )


def decode_or_poison(df: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Add the decoded fields with ``outcome`` and ``error``.

    A malformed or absent value becomes a poison row with null fields; no row is
    lost and none raises.
    """
    parsed = df.withColumn("_decoded", _parse(column, schema))
    bad = F.col("_decoded").isNull() | F.col(f"_decoded.{_CORRUPT}").isNotNull()
    return parsed.withColumn("_bad", bad).select(
        *df.columns,
        *[
            F.when(~F.col("_bad"), F.col(f"_decoded.{f.name}")).alias(f.name)
            for f in schema.fields
        ],
        F.when(F.col("_bad"), POISON).otherwise(SUCCESS).alias("outcome"),
        F.when(F.col("_bad"), DECODE_FAILED).alias("error"),
    )


def decode_polymorphic(
    df: DataFrame, types: Mapping[str, T.StructType], column: str = "content"
) -> DataFrame:
    """Decode by the ``$type`` member against the allow-list ``types``.

    The result holds the discriminator, one struct column per allowed type (null
    unless the row is of that type), ``outcome`` and ``error``.
    """
    kind = F.get_json_object(F.col(column), "$['$type']")
    tagged = df.withColumn("type_name", kind)
    for name, schema in types.items():
        tagged = tagged.withColumn(
            f"_as_{name}", F.when(F.col("type_name") == name, _parse(column, schema))
        )
    decoded = F.lit(False)
    for name in types:
        parsed = F.col(f"_as_{name}")
        decoded = decoded | (parsed.isNotNull() & parsed[_CORRUPT].isNull())
    good = F.col("_good")
    return tagged.withColumn("_good", decoded).select(
        *df.columns,
        "type_name",
        *[
            F.when(good & F.col(f"_as_{name}").isNotNull(),
                   F.struct(*[F.col(f"_as_{name}.{f.name}").alias(f.name)
                              for f in schema.fields])).alias(name)
            for name, schema in types.items()
        ],
        F.when(good, SUCCESS).otherwise(POISON).alias("outcome"),
        F.when(~good, DECODE_FAILED).alias("error"),
    )


def header_bytes(headers: Column, name: str) -> Column:
    """First header of that name as bytes; null when there is none."""
    position = F.array_position(headers["key"], name)
    return F.when(position > 0, headers["value"][position.cast("int") - 1])


def header_get(headers: Column, name: str) -> Column:
    """First header of that name as text; null when there is none.

    A cast, unlike ``decode``, does not fail on bytes that are no UTF-8.
    """
    return header_bytes(headers, name).cast("string")


def header_error(headers: Column, name: str) -> Column:
    """The failure of ``header_get``: a reason when the header is absent, else null."""
    return missing_header(header_bytes(headers, name), name)


def missing_header(value: Column, name: str) -> Column:
    """The failure for a header already read."""
    return F.when(value.isNull(), F.lit(f"header '{name}' is missing"))


def make_headers(**values: Column) -> Column:
    """Header array from text columns; null texts leave their header out.

    Underscores in the argument names stand for the hyphens of header names.
    """
    def entry(name: str, value: Column) -> Column:
        header = F.struct(F.lit(name.replace("_", "-")).alias("key"),
                          value.cast("binary").alias("value"))
        return F.when(value.isNotNull(), F.array(header)).otherwise(F.array().cast(HEADERS))

    return F.concat(*[entry(name, value) for name, value in values.items()])
