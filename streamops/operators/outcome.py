"""Three-valued outcomes: classification, routing and bounded retries."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamops.constants import (
    ENDPOINT_ERROR,
    FAILING_ENDPOINT,
    IMAGE_SUFFIX,
    MAX_DELIVERY_ATTEMPTS,
    NO_DECODER,
    POISON,
    RETRY_WAIT_MS,
    SUCCESS,
    TRANSIENT,
)
from streamops.functions.text import has_suffix

RESULT_TYPE = "struct<outcome:string,error:string>"


def succeeded() -> Column:
    return F.struct(F.lit(SUCCESS).alias("outcome"), F.lit(None).cast("string").alias("error"))


def failed(outcome: str, error: str | Column) -> Column:
    text = F.lit(error) if isinstance(error, str) else error
    return F.struct(F.lit(outcome).alias("outcome"), text.alias("error"))


def apply_strategy(df: DataFrame, strategy: Column) -> DataFrame:
    """Add ``outcome`` and ``error`` from a strategy over the record.

    ``strategy`` is any column of ``struct<outcome,error>``: an expression, or a
    pandas UDF applied to columns.
    """
    return df.withColumn("_result", strategy).select(
        *df.columns, F.col("_result.outcome"), F.col("_result.error")
    )


def classify_job(file_id: Column, saturated: Column | None = None,
                 suffix: str = IMAGE_SUFFIX) -> Column:
    """Decodable files pass, others are poison; ``saturated`` marks transient ones."""
    result = F.when(~has_suffix(file_id, suffix), failed(POISON, NO_DECODER))
    if saturated is not None:
        result = result.when(saturated, failed(TRANSIENT, "resize pool saturated"))
    return result.otherwise(succeeded())


def classify_delivery(url: Column) -> Column:
    return F.when(url.contains(FAILING_ENDPOINT), failed(TRANSIENT, ENDPOINT_ERROR)).otherwise(
        succeeded()
    )


def route_outcome(df: DataFrame) -> dict[str, DataFrame]:
    """The branches to commit, to retry and to step past."""
    return {o: df.filter(F.col("outcome") == o) for o in (SUCCESS, TRANSIENT, POISON)}


def bounded_retry(
    df: DataFrame,
    attempt: Callable[[int], Column],
    max_attempts: int = MAX_DELIVERY_ATTEMPTS,
) -> DataFrame:
    """Add the last attempt's ``outcome`` and ``error``, ``attempts`` and ``waited_ms``.

    ``attempt(n)`` is the result of the n-th try as ``struct<outcome,error>``. The
    first result that is not transient ends the tries. Each record is settled
    within its row, so nothing is exploded or shuffled.
    """
    names = [f"_try_{n}" for n in range(1, max_attempts + 1)]
    tried = df.withColumns({name: attempt(n) for n, name in enumerate(names, start=1)})
    used = F.lit(max_attempts)
    last = F.col(names[-1])
    for n in range(max_attempts - 1, 0, -1):
        ends_here = F.col(f"{names[n - 1]}.outcome") != TRANSIENT
        used = F.when(ends_here, F.lit(n)).otherwise(used)
        last = F.when(ends_here, F.col(names[n - 1])).otherwise(last)
    waits = used * (used - 1) / 2 * RETRY_WAIT_MS
    return tried.withColumns({
        "_last": last, "attempts": used.cast("int"), "waited_ms": waits.cast("long"),
    }).select(
        *df.columns, F.col("_last.outcome"), F.col("_last.error"), "attempts", "waited_ms"
    )


def retrying_udf(
    call: Callable[[pd.Series], pd.DataFrame],
    max_attempts: int = MAX_DELIVERY_ATTEMPTS,
    wait_ms: int = RETRY_WAIT_MS,
):
    """A pandas UDF that calls ``call`` on a batch and again on its transient rows.

    ``call`` maps a series to a frame with columns ``outcome`` and ``error``. The
    pause before each further try is ``wait_ms`` times the tries made, once for
    the whole batch.
    """

    @F.pandas_udf("outcome string, error string, attempts int")
    def deliver(values: pd.Series) -> pd.DataFrame:
        result = call(values).reindex(columns=["outcome", "error"])
        result.index = values.index
        result["attempts"] = 1
        for made in range(1, max_attempts):
            again = result["outcome"] == TRANSIENT
            if not again.any():
                break
            time.sleep(wait_ms * made / 1000)
            retried = call(values[again])
            result.loc[again, "outcome"] = retried["outcome"].to_numpy()
            result.loc[again, "error"] = retried["error"].to_numpy()
            result.loc[again, "attempts"] = made + 1
        return result

    return deliver


def dead_letters(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Rows to park: what failed for good, or is still transient after all tries."""
    return df.filter(F.col("outcome") != SUCCESS).select(
        F.col(key).cast("string").alias("key"),
        value.alias("value"),
        F.col("attempts"),
        F.col("error").alias("reason"),
    )
