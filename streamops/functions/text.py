"""Text, number and time expressions the operators print or test with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_suffix(col: Column, suffix: str) -> Column:
    """Suffix test that ignores case."""
    return F.lower(col).endswith(suffix.lower())


def money_text(col: Column) -> Column:
    """Two decimals, no digit grouping."""
    return col.cast("decimal(38,2)").cast("string")


def zero_padded(col: Column, width: int) -> Column:
    """Leading zeros up to ``width``; longer numbers stay whole."""
    text = col.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def left_aligned(col: Column, width: int) -> Column:
    """Pad on the right up to ``width``; longer texts stay whole."""
    return F.rpad(col, F.greatest(F.length(col), F.lit(width)), F.lit(" "))


def round_half_even(col: Column, places: int) -> Column:
    return F.bround(col, places)


def window_label(key: Column, start: Column, end: Column, count: Column) -> Column:
    """``[HH:mm:ss-HH:mm:ss] key: n views`` in the session time zone."""
    clock = "HH:mm:ss"
    return F.concat(
        F.lit("["), F.date_format(start, clock), F.lit("-"), F.date_format(end, clock),
        F.lit("] "), key, F.lit(": "), count.cast("string"), F.lit(" views"),
    )


def log_line(order_id: Column, step: Column, status: Column, reason: Column) -> Column:
    """Final saga line; the reason appears only where there is one."""
    return F.concat(
        order_id, F.lit(" FINAL: "), step, F.lit(" ("), status,
        F.coalesce(F.concat(F.lit(", "), reason), F.lit("")), F.lit(")"),
    )


def window_start_ms(ts: Column, size_ms: int) -> Column:
    """Start of the tumbling bucket of ``ts`` in epoch milliseconds."""
    ms = F.unix_millis(ts)
    return ms - F.pmod(ms, F.lit(size_ms))
