"""Daily factor scores and BUY / SELL / HOLD calls."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import mean_present, ratio
from signalloom.operators import ranking
from signalloom.operators.asof import asof_left
from signalloom.operators.rolling import rolling_block, rolling_sum

# The model's windows in rows and its buckets.
AVERAGE_ROWS = 200
SKIP_ROWS = 21
LOOKBACK_ROWS = 252
BUCKETS = 5
FACTORS_NEEDED = 2

FACTOR_RANKS = {
    "r_ey": "earnings_yield",
    "r_btm": "book_to_market",
    "r_roe": "roe",
    "r_growth": "revenue_growth_yoy",
    "r_mom": "momentum_12_1",
}


def technicals(
    prices: DataFrame,
    ma: int = AVERAGE_ROWS,
    skip: int = SKIP_ROWS,
    lookback: int = LOOKBACK_ROWS,
) -> DataFrame:
    """Moving average over ``ma`` rows, once there are that many, and momentum from ``lookback``
    to ``skip`` rows ago.

    Clean prices hold one row per ticker and day, so a ticker's window is bounded by the calendar
    however its raw rows are skewed.
    """
    timeline = Window.partitionBy("ticker").orderBy("date")
    numbered = prices.select(
        "date",
        "ticker",
        "close",
        F.row_number().over(timeline).alias("_n"),
        (F.lag("close", skip).over(timeline) / F.lag("close", lookback).over(timeline) - 1).alias(
            "momentum_12_1"
        ),
        *rolling_block(F.col("close"), ma, timeline, "_block"),
    )
    return numbered.select(
        "date",
        "ticker",
        "close",
        F.when(F.col("_n") >= ma, rolling_sum("_block", ma, timeline) / ma).alias("ma_200"),
        "momentum_12_1",
    )


def with_fundamentals(
    technical: DataFrame, fundamentals: DataFrame, universe: DataFrame, strategy: str = "interval"
) -> DataFrame:
    """Add sector and the ratios from the latest filing public on each day. Members only."""
    members = technical.join(universe.select("ticker", "sector"), "ticker")
    known = fundamentals.select(
        "ticker",
        "available_from",
        "period_end",
        "ttm_eps",
        "book_value_per_share",
        "roe",
        "revenue_growth_yoy",
    )
    joined = asof_left(
        members, known, ["ticker"], "date", "available_from", ["period_end"], strategy
    )
    return joined.select(
        "date",
        "ticker",
        "sector",
        "close",
        "ma_200",
        "momentum_12_1",
        ratio(F.col("ttm_eps"), F.col("close")).alias("earnings_yield"),
        ratio(F.col("book_value_per_share"), F.col("close")).alias("book_to_market"),
        "roe",
        "revenue_growth_yoy",
    )


def sector_ranks(
    df: DataFrame, metrics: Mapping[str, str] = FACTOR_RANKS, strategy: str = "window"
) -> DataFrame:
    """Percentile ranks within sector and day.

    The strategy ``window`` ranks a day in one task; then all ranks, and the buckets that follow,
    come from a single shuffle by day, which suits loads of many days. ``sliced`` spreads a day
    over all tasks, which suits a load of one day and universes of any size. Both give the same.
    """
    if ranking.sliced(strategy):
        return ranking.percent_ranks(df, ["date", "sector"], metrics)
    return ranking.percent_ranks_by_window(df.repartition("date"), ["date", "sector"], metrics)


def score(ranked: DataFrame, strategy: str = "window") -> DataFrame:
    """Factor scores, composite, quintile and call. ``strategy`` as in :func:`sector_ranks`."""
    factors = ranked.withColumns(
        {
            "value_score": mean_present(F.col("r_ey"), F.col("r_btm")),
            "quality_score": mean_present(F.col("r_roe"), F.col("r_growth")),
            "momentum_score": F.col("r_mom"),
        }
    )
    parts = [F.col(c) for c in ("value_score", "quality_score", "momentum_score")]
    present = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    composed = factors.withColumn(
        "composite_score", F.when(present >= FACTORS_NEEDED, mean_present(*parts))
    )
    tile = ranking.ntile if ranking.sliced(strategy) else ranking.ntile_by_window
    bucketed = tile(composed, ["date"], "composite_score", ["ticker"], BUCKETS, "quintile")
    call = (
        F.when((F.col("quintile") == BUCKETS) & (F.col("close") > F.col("ma_200")), "BUY")
        .when(F.col("quintile") == 1, "SELL")
        .otherwise("HOLD")
    )
    return bucketed.select(
        "date",
        "ticker",
        "sector",
        "close",
        "ma_200",
        "momentum_12_1",
        "earnings_yield",
        "book_to_market",
        "roe",
        "revenue_growth_yoy",
        "value_score",
        "quality_score",
        "momentum_score",
        "composite_score",
        F.col("quintile").cast("tinyint").alias("quintile"),
        call.alias("signal"),
    )


def history_start(
    prices: DataFrame, start: date, rows: int = LOOKBACK_ROWS, end: date | None = None, days: Iterable[date] | None = None
) -> date | None:
    """The earliest day that the windows of the days from ``start`` to ``end`` can reach back to.

    Windows count rows, so a ticker with gaps needs more days than others; only tickers with a price
    in the range count. Runs an aggregate over dates and tickers. With the ``days`` that are stored,
    it looks at as many days as a window has rows first, and at earlier ones only while some ticker
    of the range has too few rows there. None without earlier prices.
    """
    latest_first = Window.partitionBy("ticker").orderBy(F.desc("date"))
    active = prices.where(F.col("date") >= F.lit(start))
    if end is not None:
        active = active.where(F.col("date") <= F.lit(end))
    active = active.select("ticker").distinct()
    earlier = prices.where(F.col("date") < F.lit(start)).select("date", "ticker")

    def reached(since: date | None) -> tuple[date | None, bool]:
        """The earliest day needed from ``since`` on, and whether some ticker may need earlier ones."""
        seen = earlier if since is None else earlier.where(F.col("date") >= F.lit(since))
        numbered = seen.join(active, "ticker", "left_semi").select("ticker", "date", F.row_number().over(latest_first).alias("_n"))
        per_ticker = active.join(numbered.where(F.col("_n") <= rows).groupBy("ticker").agg(F.min("date").alias("d"), F.count("*").alias("n")), "ticker", "left")
        found = per_ticker.agg(F.min("d").alias("d"), F.bool_or(F.coalesce("n", F.lit(0)) < rows).alias("short")).first()
        return found["d"], bool(found["short"])

    known = sorted(d for d in days if d < start) if days is not None else []
    span = rows
    while span < len(known):
        day, short = reached(known[-span])
        if not short:
            return day
        span *= 4
    return reached(None)[0]


def reach_end(prices: DataFrame, start: date, end: date, rows: int = LOOKBACK_ROWS) -> date:
    """The last day whose windows reach back to a price dated from ``start`` to ``end``."""
    touched = prices.where(F.col("date").between(F.lit(start), F.lit(end))).select("ticker").distinct()
    later = prices.where(F.col("date") > F.lit(end)).select("date", "ticker").join(touched, "ticker", "left_semi")
    reached = later.select("date", F.row_number().over(Window.partitionBy("ticker").orderBy("date")).alias("_n"))
    return reached.where(F.col("_n") <= rows).agg(F.max("date").alias("d")).first()["d"] or end


def daily_signals(
    prices: DataFrame,
    fundamentals: DataFrame,
    universe: DataFrame,
    start: date | None = None,
    end: date | None = None,
    history_days: int | None = None,
    ma: int = AVERAGE_ROWS,
    skip: int = SKIP_ROWS,
    lookback: int = LOOKBACK_ROWS,
    strategy: str = "window",
    asof: str = "interval",
) -> DataFrame:
    """Signals for the days from ``start`` to ``end``, from all earlier prices it is given.

    ``history_days`` cuts the prices to that many days before ``start``, whatever gaps a ticker
    has; a caller that wants short scans without changing results passes prices from
    :func:`history_start` on. ``strategy`` is that of :func:`sector_ranks`, ``asof`` that of the
    as-of join.
    """
    if start is not None and history_days is not None:
        prices = prices.where(F.col("date") >= F.lit(start - timedelta(days=history_days)))
    if end is not None:
        prices = prices.where(F.col("date") <= F.lit(end))
    technical = technicals(prices, ma, skip, lookback)
    if start is not None:
        technical = technical.where(F.col("date") >= F.lit(start))
    return signals_of(technical, fundamentals, universe, strategy, asof)


def signals_of(
    technical: DataFrame, fundamentals: DataFrame, universe: DataFrame, strategy: str = "window", asof: str = "interval"
) -> DataFrame:
    """Signals of the days whose technicals are given; options as in :func:`daily_signals`."""
    joined = with_fundamentals(technical, fundamentals, universe, asof)
    scored = score(sector_ranks(joined, FACTOR_RANKS, strategy), strategy)
    # What strategies store comes back as columns that may be NULL, so all of them say so.
    open_to_null = {c: F.when(F.lit(False), F.lit(None)).otherwise(F.col(c)) for c in ("date", "ticker", "close")}
    return scored.withColumns(open_to_null)
