"""Monthly hold-band strategy against a benchmark."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom import schemas
from signalloom.functions import wealth
from signalloom.operators.latch import latch
from signalloom.plans.analysis import month_ends, on_days

# Starting capital, benchmark, and the lowest quintile at which a stock is kept.
CAPITAL = 10_000_000
BENCHMARK = "SPY"
KEEP_QUINTILE = 4


def positions(signals: DataFrame, days: Sequence[date]) -> DataFrame:
    """Whether each stock is held after each month end, and its return to the next one.

    A stock enters on a BUY and stays until it drops below ``KEEP_QUINTILE``. A BUY implies the
    top quintile, so it always leaves the stock held, and a low or missing quintile always leaves
    it out; the state is that of the latest such month.
    """
    timeline = Window.partitionBy("ticker").orderBy("date")
    monthly = on_days(signals.select("date", "ticker", "quintile", "signal", "close"), days)
    return monthly.select(
        "date",
        "ticker",
        F.row_number().over(timeline).cast("bigint").alias("month_no"),
        latch(_enters(), _leaves(), timeline).alias("held"),
        (F.lead("close").over(timeline) / F.col("close") - 1).alias("next_month_return"),
    )


def _enters() -> Column:
    return F.col("signal") == "BUY"


def _leaves() -> Column:
    return F.coalesce("quintile", F.lit(0)) < KEEP_QUINTILE


def no_positions(spark: SparkSession) -> DataFrame:
    """The state before the first month end."""
    return spark.createDataFrame([], schemas.POSITION_STATE)


def positions_step(
    state: DataFrame, signals: DataFrame, days: Sequence[date]
) -> tuple[DataFrame, DataFrame]:
    """:func:`positions` of further month ends, from the latest position of each ticker.

    ``days`` come after those that ``state`` knows. The first result holds the positions whose next
    month end is known by now, those of ``state`` among them; the second is the state after
    ``days``, the latest position of each ticker. Positions are settled once, and a step reads its
    own month ends and a row per ticker. All settled positions, and the state with its return still
    missing (:func:`open_positions`), equal the positions of one run.
    """
    fresh = on_days(signals.select("date", "ticker", "quintile", "signal", "close"), days)
    series = state.unionByName(fresh, allowMissingColumns=True)
    timeline = Window.partitionBy("ticker").orderBy("date")
    # The row of the state, where there is one, is the first of its ticker and the only one numbered.
    carried = F.coalesce(F.first("month_no").over(timeline), F.lit(1))
    known = F.col("held")
    walked = series.select(
        "date",
        "ticker",
        (carried + F.row_number().over(timeline) - 1).cast("bigint").alias("month_no"),
        latch(F.coalesce(known, _enters()), F.coalesce(~known, _leaves()), timeline).alias("held"),
        "close",
        F.lead("date").over(timeline).alias("_next"),
        (F.lead("close").over(timeline) / F.col("close") - 1).alias("next_month_return"),
    )
    settled = walked.where(F.col("_next").isNotNull()).drop("close", "_next")
    return settled, walked.where(F.col("_next").isNull()).drop("_next", "next_month_return")


def open_positions(state: DataFrame) -> DataFrame:
    """The positions of a state, whose return is not known yet."""
    return state.drop("close").withColumn("next_month_return", F.lit(None).cast("double"))


def benchmark_prices(prices: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    return prices.where(F.col("ticker") == benchmark).select("date", "close")


def benchmark_returns(benchmark: DataFrame, days: Sequence[date]) -> DataFrame:
    """Benchmark return to the next month end; one row per month, so one ordered window."""
    timeline = Window.orderBy("date")
    return on_days(benchmark, days).select(
        "date", (F.lead("close").over(timeline) / F.col("close") - 1).alias("spy_return")
    )


def backtest(
    signals: DataFrame,
    prices: DataFrame,
    benchmark: str = BENCHMARK,
    capital: float = CAPITAL,
) -> DataFrame:
    """Equity curves of the strategy and the benchmark, rebalanced at the benchmark's month ends.

    Held stocks are weighted equally. Months without a holding are left out of both curves.
    """
    market = benchmark_prices(prices, benchmark)
    days = month_ends(market)
    return equity_curves(positions(signals, days), benchmark_returns(market, days), capital)


def equity_curves(held: DataFrame, market: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """:func:`backtest` of positions and benchmark returns that are there already, such as stored ones."""
    strategy = (
        held.where(F.col("held") & F.col("next_month_return").isNotNull())
        .groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("holdings"),
            F.avg("next_month_return").alias("strategy_return"),
        )
    )
    months = strategy.join(market, "date").where(F.col("spy_return").isNotNull())
    # One row per month from here on.
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return months.select(
        F.col("date").alias("rebalance_date"),
        "holdings",
        "strategy_return",
        "spy_return",
        wealth(capital, F.col("strategy_return"), so_far).alias("strategy_value"),
        wealth(capital, F.col("spy_return"), so_far).alias("spy_value"),
    ).orderBy("rebalance_date")


def performance_summary(curve: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Final value, multiple of the capital and annualised return of both curves.

    Each row of the curve is one month of holding.
    """

    final = curve.agg(
        F.count(F.lit(1)).alias("months"),
        F.max_by("strategy_value", "rebalance_date").alias("_strategy"),
        F.max_by("spy_value", "rebalance_date").alias("_benchmark"),
    )
    portfolios = F.array(
        F.struct(F.lit("strategy").alias("portfolio"), F.col("_strategy").alias("final_value")),
        F.struct(F.lit("benchmark").alias("portfolio"), F.col("_benchmark").alias("final_value")),
    )
    multiple = F.col("final_value") / F.lit(float(capital))
    return final.select("months", F.inline(portfolios)).select(
        "portfolio",
        "months",
        "final_value",
        multiple.alias("multiple"),
        F.when(F.col("months") > 0, F.pow(multiple, F.lit(12.0) / F.col("months")) - 1).alias(
            "annual_return"
        ),
    )
