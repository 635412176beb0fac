"""Sums over the last n rows of a series, in a few steps instead of n per row.

Spark adds up a sliding frame again for every row. Cutting the frame into equal blocks needs one
short sliding sum and then a handful of look-backs to earlier blocks: 200 rows are ten sums of
twenty. Both steps use the same window, so there is no further shuffle or sort. Unlike differences of
running totals, no rounding error or infinity from outside the frame gets into a result.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def block_length(rows: int) -> int:
    """The least divisor of ``rows`` from its square root up; a prime is one block."""
    return next(b for b in range(isqrt(rows - 1) + 1, rows + 1) if rows % b == 0)


def rolling_block(value: Column, rows: int, series: WindowSpec, name: str) -> list[Column]:
    """First step: the sum over the last block. Pass the result to ``select``."""
    block = series.rowsBetween(1 - block_length(rows), Window.currentRow)
    return [F.sum(value).over(block).alias(name)]


def rolling_sum(block: str, rows: int, series: WindowSpec) -> Column:
    """Second step: the sum over the last ``rows`` rows. NULL while there are fewer blocks."""
    length = block_length(rows)
    total = F.col(block)
    for k in range(length, rows, length):
        total = total + F.lag(block, k).over(series)
    return total
