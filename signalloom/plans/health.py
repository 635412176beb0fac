"""Load monitoring: one status per expected trading day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits that trigger a status.
LATE_AFTER_HOURS = 30
LOW_VOLUME_SHARE = 0.95
TRAILING_DAYS = 20
DROPPED_SHARE = 0.05
JUMP = 0.5


def price_jumps(prices: DataFrame, limit: float = JUMP) -> DataFrame:
    """Per day, the number of stocks that moved by more than ``limit`` since their last price."""
    timeline = Window.partitionBy("ticker").orderBy("date")
    moves = prices.select(
        "date", (F.col("close") / F.lag("close").over(timeline) - 1).alias("_move")
    )
    return (
        moves.where(F.abs("_move") > limit)
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("suspicious_moves"))
    )


def latest_loads(log: DataFrame, asset: str = "clean_prices") -> DataFrame:
    """Per day, the counts of its latest load and the time of its first scheduled one."""

    def newest(name: str) -> Column:
        # An unknown count does not hide an earlier known one.
        when = F.when(F.col(name).isNotNull(), F.struct("loaded_at", F.col(name).alias("_x")))
        return F.max(when)["_x"].alias(name)

    return (
        log.where(F.col("asset") == asset)
        .groupBy(F.col("partition_date").alias("date"))
        .agg(
            newest("raw_rows"),
            newest("clean_rows"),
            F.min(F.when(~F.col("is_backfill"), F.col("loaded_at"))).alias("first_scheduled_load"),
        )
    )


def pipeline_health(
    calendar: DataFrame, log: DataFrame, prices: DataFrame, as_of: date | None = None
) -> DataFrame:
    """Row counts and a status for each session from the first logged day to the day before
    ``as_of`` (today when not given)."""
    today = F.lit(as_of) if as_of else F.current_date()
    first_logged = log.agg(F.min("partition_date")).scalar()
    sessions = calendar.where(
        (F.col("session_date") >= first_logged) & (F.col("session_date") <= F.date_sub(today, 1))
    ).select(F.col("session_date").alias("date"))
    # One row per session from here on, so the ordered window is bounded by the calendar.
    trailing = Window.orderBy("date").rowsBetween(-TRAILING_DAYS, -1)
    daily = (
        sessions.join(latest_loads(log), "date", "left")
        .join(price_jumps(prices), "date", "left")
        .select(
            "date",
            "raw_rows",
            "clean_rows",
            (F.col("raw_rows") - F.col("clean_rows")).alias("rows_dropped"),
            "first_scheduled_load",
            F.avg("clean_rows").over(trailing).alias("trailing_avg_rows"),
            F.coalesce("suspicious_moves", F.lit(0)).cast("bigint").alias("suspicious_moves"),
        )
    )
    deadline = F.col("date").cast("timestamp_ntz") + F.expr(f"INTERVAL {LATE_AFTER_HOURS} HOURS")
    status = (
        F.when(F.coalesce("clean_rows", F.lit(0)) == 0, "MISSING")
        .when(F.col("first_scheduled_load") > deadline, "LATE")
        .when(F.col("clean_rows") < LOW_VOLUME_SHARE * F.col("trailing_avg_rows"), "LOW_VOLUME")
        .when(F.col("rows_dropped") > DROPPED_SHARE * F.col("raw_rows"), "HIGH_DUPES")
        .when(F.col("suspicious_moves") > 0, "CHECK_PRICES")
        .otherwise("OK")
    )
    return daily.withColumn("status", status).orderBy("date")
