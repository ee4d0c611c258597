"""Explicit schemas of the record types; nothing is ever inferred from data."""

from pyspark.sql import types as T

RATE = T.DecimalType(18, 6)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_s, _i, _l, _d = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_ts, _b = T.TimestampType(), T.BooleanType()

HEADERS = T.ArrayType(_struct(key=_s, value=T.BinaryType()))

# The keyed log has the column layout of Spark's Kafka source.
LOG = _struct(
    topic=_s, partition=_i, offset=_l, timestamp=_ts, key=_s, value=_s, headers=HEADERS
)

RIDE_REQUEST = _struct(city=_s, ride_id=_s, fare=_d)
OUTBOX = _struct(
    id=_s, sequence=_l, topic=_s, entity_type=_s, entity_id=_s, content=_s,
    occurred_on=_ts, processed_on=_ts, state=_s, retry_count=_i, error=_s,
)
LEDGER = _struct(transaction_id=_s, processed_on=_ts, payload=_s)
