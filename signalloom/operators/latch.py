"""On/off state carried along an ordered series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec, Window


def latch(turn_on: Column, turn_off: Column, series: WindowSpec) -> Column:
    """State that goes on with ``turn_on``, off with ``turn_off`` and holds otherwise.

    Starts off. The two conditions must exclude each other; then the state at a row is decided
    by the latest row at which either held, and a month-by-month walk becomes one window.
    """
    event = F.when(turn_on, F.lit(True)).when(turn_off, F.lit(False))
    so_far = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(F.last(event, ignorenulls=True).over(so_far), F.lit(False))
