"""Fast-path filter for ids handled within the retention time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamops.constants import DEDUP_RETENTION_HOURS, SUCCESS


def _one_success_per_id(rows: pd.DataFrame, key: str, order: str) -> pd.DataFrame:
    """All failed rows, and per id the first of the successful ones."""
    ok = rows["outcome"] == SUCCESS
    first = rows[ok].sort_values(order).drop_duplicates(key)
    return pd.concat([rows[~ok], first], ignore_index=True)


def anti_cache(df: DataFrame, key: str, order: str,
               hours: float = DEDUP_RETENTION_HOURS) -> DataFrame:
    """Drop rows whose id has succeeded in an earlier batch, and repeated successes.

    An id is remembered for ``hours`` once a row of it has the outcome
    ``success``; rows that failed leave no mark. The ledger stays the guarantee,
    so this filter may be left out without changing results. Copies of one id
    collapse inside the Arrow batches of the scan, before the shuffle to the
    state store, and there at most one row per id is held. Drain it with
    ``no_data_batches=False``.
    """
    ttl_ms = max(round(hours * 3_600_000), 1)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield _one_success_per_id(rows, key, order)

    class Seen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "marked boolean", ttl_ms)

        def handleInputRows(self, keys, rows, timer_values) -> Iterator[pd.DataFrame]:
            if self.seen.exists():
                return
            success = None
            for chunk in rows:
                if success is not None:
                    chunk = pd.concat([chunk, success], ignore_index=True)
                kept = _one_success_per_id(chunk, key, order)
                ok = kept["outcome"] == SUCCESS
                success = kept[ok] if ok.any() else None
                yield kept[~ok]
            if success is not None:
                self.seen.update((True,))
                yield success

        def close(self) -> None:
            pass

    slim = df.mapInPandas(combine, df.schema)
    return slim.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Seen(), outputStructType=df.schema,
        outputMode="Append", timeMode="ProcessingTime",
    )
