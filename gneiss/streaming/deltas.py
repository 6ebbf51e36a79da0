"""Structured Streaming forms of the maintenance operators.

The batch operators know no streams; these are the same keyed folds for tables that grow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.sources.versioned import VersionedTable


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, key, n): tumbling counts; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def first_of_key(events: DataFrame, ts: str, key: str, late: str = "2 days") -> DataFrame:
    """One row a key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def append_batches(sink: VersionedTable, name: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that publishes each batch once.

    The batch number is saved in the commit of its rows, so a batch that is
    replayed after a failure is skipped if its commit was made.
    """

    def run(batch: DataFrame, number: int) -> None:
        at = sink.manifest()
        if number > at.processed.get(name, -1):
            sink.commit(transform(batch), processed={name: number}, base=at.version)

    return run
