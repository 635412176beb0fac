"""Reports over the stored signals."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import calendar_month, share_where
from signalloom.operators import ranking
from signalloom.plans.signals import BUCKETS
from signalloom.session import stage

# Longest gap, in days, that still counts as holding to the next month end.
MAX_GAP_DAYS = 40

# How far back streaks are counted.
LOOKBACK = "2 years"


def month_ends(df: DataFrame) -> list[date]:
    """The last day with rows of each calendar month.

    Fetched as values, one per month, because a list of dates prunes stored day folders and
    passes below the daily rankings, which a join would not.
    """
    last = df.groupBy(calendar_month(F.col("date")).alias("month")).agg(F.max("date").alias("day"))
    return sorted(r["day"] for r in last.select("day").collect())


def last_of_months(days: Iterable[date]) -> list[date]:
    """:func:`month_ends` of days already known, such as those of stored folders."""
    last = {(d.year, d.month): d for d in sorted(days)}
    return list(last.values())


def on_days(df: DataFrame, days: Sequence[date]) -> DataFrame:
    """Rows dated on one of ``days``."""
    return df.where(F.col("date").isin(list(days))) if days else df.where(F.lit(False))


def report_rows(signals: DataFrame, latest: date, days: Iterable[date], lookback: str = LOOKBACK) -> DataFrame:
    """What all reports read of the signals, in one pass: every column of ``days``, and of the other
    days in ``lookback`` before ``latest`` the call alone. ``whole`` tells the two apart.

    A report over these rows equals the one over all signals. They are stored by ``whole``, so that
    reports of month ends pass over the look-back.
    """
    whole = F.col("date").isin(sorted(days))
    recent = F.col("date") >= F.lit(latest) - F.expr(f"INTERVAL {lookback}")
    call = ("date", "ticker", "signal")
    columns = [F.col(c) if c in call else F.when(whole, F.col(c)).alias(c) for c in signals.columns]
    return signals.where(whole | recent).select(*columns, whole.alias("whole"))


def todays_signals(
    signals: DataFrame, universe: DataFrame, lookback: str = LOOKBACK, latest: date | None = None
) -> DataFrame:
    """Every BUY and SELL of the latest day, its scores, and how long the call has stood.

    Streaks are counted over ``lookback`` only.
    """
    latest = latest or signals.agg(F.max("date").alias("d")).first()["d"]
    today = F.lit(latest).cast("date")
    calls = signals.where((F.col("date") == today) & (F.col("signal") != "HOLD"))
    # The history moves as three columns, and only for stocks with a call.
    recent = (
        signals.where(F.col("date") >= today - F.expr(f"INTERVAL {lookback}"))
        .select("date", "ticker", "signal")
        .join(calls.select("ticker"), "ticker", "left_semi")
    )
    timeline = Window.partitionBy("ticker").orderBy("date")
    so_far = timeline.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A run starts where the call differs from the row before. The latest start so far gives
    # both the first day of the current run and, by row number, its length.
    numbered = recent.select(
        "*",
        F.row_number().over(timeline).alias("_n"),
        (F.lag("signal").over(timeline) == F.col("signal")).alias("_same"),
    )
    starts = F.when(
        ~F.coalesce(F.col("_same"), F.lit(False)), F.struct(F.col("_n"), F.col("date"))
    )
    runs = (
        numbered.select(
            "date", "ticker", "_n", F.last(starts, ignorenulls=True).over(so_far).alias("_run")
        )
        .where(F.col("date") == today)
        .drop("date")
    )
    return (
        calls.join(universe.select("ticker", "company"), "ticker")
        .join(runs, "ticker")
        .select(
            "date",
            "ticker",
            "company",
            "sector",
            "signal",
            F.col("_run.date").alias("signal_since"),
            (F.col("_n") - F.col("_run._n") + 1).cast("bigint").alias("trading_days_in_signal"),
            *[
                F.round(c, 3).alias(c)
                for c in ("composite_score", "value_score", "quality_score", "momentum_score")
            ],
            "close",
            "ma_200",
            "earnings_yield",
            "roe",
            "momentum_12_1",
            F.col("composite_score").alias("_order"),
        )
        .orderBy(F.col("signal").asc(), F.col("_order").desc_nulls_last(), "ticker")
        .drop("_order")
    )


def signal_validation(
    signals: DataFrame,
    max_gap: int = MAX_GAP_DAYS,
    days: Sequence[date] | None = None,
    strategy: str = "window",
) -> DataFrame:
    """Return to the next month end by month end and quintile: count, mean and median.

    ``days`` are the month ends of the signals and are looked up when not given. The strategy
    ``window`` takes Spark's median, which holds the members of a quintile in memory; ``sliced``
    takes it from sorted slices, for universes of any size.
    """
    monthly = on_days(signals, month_ends(signals) if days is None else days)
    timeline = Window.partitionBy("ticker").orderBy("date")
    held = (
        monthly.select(
            "date",
            "ticker",
            "quintile",
            "close",
            F.lead("close").over(timeline).alias("_next_close"),
            F.lead("date").over(timeline).alias("_next_date"),
        )
        .where(
            F.col("quintile").isNotNull() & (F.datediff("_next_date", "date") <= max_gap)
        )
        .select(
            F.col("date").alias("rebalance_date"),
            "quintile",
            "ticker",
            (F.col("_next_close") / F.col("close") - 1).alias("_return"),
        )
    )
    by = ["rebalance_date", "quintile"]
    summary = [
        F.count(F.lit(1)).alias("stocks"),
        F.avg("_return").alias("avg_next_month_return"),
    ]
    median = "median_next_month_return"
    if ranking.sliced(strategy):
        held = stage(held, "held")  # read by the counts, the means and the medians
        middle = ranking.medians(held, by, "_return", ["ticker"], median)
        report = held.groupBy(*by).agg(*summary).join(middle, by, "left")
    else:
        report = held.groupBy(*by).agg(*summary, F.median("_return").alias(median))
    return report.orderBy(*by)


def quintile_spread(validation: DataFrame) -> DataFrame:
    """Mean return of the top quintile less that of the bottom one, per month end."""

    def mean_of(bucket: int):
        return F.max(F.when(F.col("quintile") == bucket, F.col("avg_next_month_return")))

    return (
        validation.groupBy("rebalance_date")
        .agg(mean_of(BUCKETS).alias("top_return"), mean_of(1).alias("bottom_return"))
        .select(
            "rebalance_date",
            "top_return",
            "bottom_return",
            (F.col("top_return") - F.col("bottom_return")).alias("spread"),
        )
        .orderBy("rebalance_date")
    )


def sector_heatmap(signals: DataFrame, days: Sequence[date] | None = None) -> DataFrame:
    """Share of each sector called BUY and SELL at each month end."""
    monthly = on_days(signals, month_ends(signals) if days is None else days)
    return (
        monthly.groupBy(calendar_month(F.col("date")).alias("month"), "sector")
        .agg(
            F.count(F.lit(1)).alias("stocks"),
            share_where(F.col("signal") == "BUY").alias("buy_share"),
            share_where(F.col("signal") == "SELL").alias("sell_share"),
            F.avg("composite_score").alias("avg_composite_score"),
        )
        .withColumn("net_buy_share", F.col("buy_share") - F.col("sell_share"))
        .select(
            "month",
            "sector",
            "stocks",
            "buy_share",
            "sell_share",
            "net_buy_share",
            "avg_composite_score",
        )
        .orderBy("month", "sector")
    )
