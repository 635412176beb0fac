"""Window figures carried from day to day by a state per ticker.

Averages and momentum of a day look back 252 rows. Reading that history again for every day costs a
year of prices per day. Here a row per ticker holds its last closes, oldest first, and how many rows
it has had; a step puts the prices of some days behind them, which gives the figures of those days
and the state after them. A step reads the state and its own days, nothing else. Closes are added up
in the order of :mod:`signalloom.operators.rolling`, so the figures equal those of the windows to
the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom import schemas
from signalloom.operators.rolling import block_length
from signalloom.plans.signals import AVERAGE_ROWS, LOOKBACK_ROWS, SKIP_ROWS


def no_state(spark: SparkSession) -> DataFrame:
    """The state before the first price."""
    return spark.createDataFrame([], schemas.TECHNICAL_STATE)


def _met(state: DataFrame, prices: DataFrame) -> DataFrame:
    """A row per ticker: ``_n`` rows before, ``_new`` prices in order, and ``_all`` closes at hand."""
    arrived = prices.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("_new"))
    # The state is as wide as its ring: where it is stored by ticker, only the new prices move.
    both = state.join(arrived, "ticker", "full_outer")
    none = F.array().cast("array<double>")
    return both.select(
        "ticker",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("_n"),
        F.coalesce(F.size("closes"), F.lit(0)).alias("_held"),
        F.coalesce("_new", F.array().cast("array<struct<date:date,close:double>>")).alias("_new"),
        F.concat(F.coalesce("closes", none), F.coalesce(F.col("_new.close"), none)).alias("_all"),
    )


def _mean(at: Column, rows: int) -> Column:
    """Mean of the ``rows`` closes up to place ``at``: sums of blocks, the latest first."""
    length = block_length(rows)
    total = None
    for back in range(0, rows, length):
        block = F.aggregate(F.slice("_all", at - (back + length - 2), F.lit(length)), F.lit(0.0), lambda s, x: s + x)
        total = block if total is None else total + block
    return total / rows


def step(
    state: DataFrame,
    prices: DataFrame,
    ma: int = AVERAGE_ROWS,
    skip: int = SKIP_ROWS,
    lookback: int = LOOKBACK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Technicals of the days in ``prices``, and the state after them.

    ``prices`` are all prices after those that ``state`` knows, one per ticker and day. Tickers
    without a new price keep their state.
    """
    keep = max(lookback, ma - 1)
    met = _met(state, prices)

    def figures(x: Column, i: Column) -> Column:
        at = F.col("_held") + i
        before = lambda rows: F.get("_all", at - rows)
        return F.struct(
            x["date"].alias("date"),
            x["close"].alias("close"),
            F.when(F.col("_n") + i + 1 >= ma, _mean(at, ma)).alias("ma_200"),
            (before(skip) / before(lookback) - 1).alias("momentum_12_1"),
        )

    rows = met.select("ticker", F.inline(F.transform("_new", figures))).select(
        "date", "ticker", "close", "ma_200", "momentum_12_1"
    )
    after = met.select(
        "ticker",
        (F.col("_n") + F.size("_new")).alias("n"),
        F.slice("_all", F.greatest(F.size("_all") - keep, F.lit(0)) + 1, F.lit(keep)).alias("closes"),
    )
    return rows, after
