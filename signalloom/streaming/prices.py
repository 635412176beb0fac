"""Load prices for whatever raw files have landed since the last run.

This replaces a clock-driven daily load: Structured Streaming remembers the files it has seen, so
a run picks up new days, late files and restated days alike, and stops when there are no more.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from signalloom import schemas
from signalloom.plans.pipeline import Warehouse
from signalloom.plans.signals import reach_end


def day_ranges(days: Iterable[date]) -> list[tuple[date, date]]:
    """Days grouped into ranges that hold no other day."""
    ranges: list[tuple[date, date]] = []
    for day in sorted(days):
        if ranges and day - ranges[-1][1] <= timedelta(days=1):
            ranges[-1] = (ranges[-1][0], day)
        else:
            ranges.append((day, day))
    return ranges


def load_new_quotes(warehouse: Warehouse, with_signals: bool = True) -> StreamingQuery:
    """Start a run over all unseen raw files; it ends by itself.

    A batch only tells which days changed. Those days are then read whole from the raw folder,
    because replacing a day from its new files alone would lose the older ones. A batch that is
    repeated after a failure gives the same tables, the audit log included: its rows go by the batch.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        # One row per calendar day in the batch.
        days = [r["date"] for r in batch.select("date").distinct().collect()]
        changed = [
            (start, end)
            for start, end in day_ranges(days)
            if warehouse.load_prices(start, end, load_id=f"stream-{batch_id}-{start}") is not None
        ]
        if changed and with_signals:
            # A late price moves the windows of its ticker for as many rows as they are long.
            start = min(r[0] for r in changed)
            warehouse.load_signals(start, reach_end(warehouse.prices(), start, max(r[1] for r in changed)))

    arrivals = warehouse.spark.readStream.schema(schemas.RAW_QUOTES).parquet(
        warehouse.path("raw/prices")
    )
    return (
        arrivals.writeStream.foreachBatch(load)
        .option("checkpointLocation", warehouse.path("meta/quote_stream"))
        .trigger(availableNow=True)
        .start()
    )
