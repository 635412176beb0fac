"""

All queries run over whole tables. The market they need is derived from the test tables by
``testing.market``; the plain names use a ticker per supplier, so that every table grows with
the data, the names ending in ``_dense`` a ticker per nation, which gives long unbroken series.
"""

from __future__ import annotations

import importlib
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta
from importlib.util import find_spec
from pathlib import Path

from pyspark.errors import PySparkException as SparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles as sql  # noqa: E402
from signalloom.operators.dedupe import surplus_rows  # noqa: E402
from signalloom.plans import analysis, backtest, clean, fundamentals, health, signals  # noqa: E402
from signalloom import schemas  # noqa: E402
from signalloom.plans.pipeline import Warehouse  # noqa: E402
from signalloom.session import fresh_path, stage  # noqa: E402
from signalloom.sources import catalog, landing, readers, writers  # noqa: E402
from testing.market import Market  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]


# Places kept of a mean of 200 prices: such means are multiples of half a millionth, so fewer
# places would cut exactly between two values and leave the choice to the last bit.
MEAN_PLACES = 7


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round computed doubles, whose last bits depend on the order of a sum."""
    return df.withColumns(
        {n: F.round(n, MEAN_PLACES if n == "ma_200" else digits) for n in names}
    )


# ------------------------------------------------------------------ shared steps


def _prices(m: Market) -> DataFrame:
    return clean.clean_prices(m.raw_quotes)


def _fundamentals(m: Market) -> DataFrame:
    return fundamentals.company_fundamentals(m.filing_headers, m.filing_facts, m.universe)


def _signals(m: Market, **options) -> DataFrame:
    return signals.daily_signals(_prices(m), _fundamentals(m), m.universe, **options)


def _stored_prices(m: Market) -> DataFrame:
    """Clean prices as a stored table, for reports that read them more than once."""
    return stage(_prices(m), "prices")


def _reported_signals(m: Market) -> tuple[DataFrame, DataFrame]:
    """Signals for reports of some days, and the member prices that tell which days there are.

    A signal is a price of a member, so the days are looked up without scoring any.
    """
    prices = _stored_prices(m)
    members = prices.join(m.universe.select("ticker"), "ticker", "left_semi")
    return signals.daily_signals(prices, _fundamentals(m), m.universe), members


def _joined(m: Market, strategy: str = "interval") -> DataFrame:
    return signals.with_fundamentals(
        signals.technicals(_prices(m)), _fundamentals(m), m.universe, strategy
    )


def _round_signals(df: DataFrame) -> DataFrame:
    return rounded(
        df, 6, "ma_200", "momentum_12_1", "earnings_yield", "book_to_market", "roe",
        "revenue_growth_yoy", "value_score", "quality_score", "momentum_score", "composite_score",
    )


def _round_joined(df: DataFrame) -> DataFrame:
    return rounded(
        df, 6, "ma_200", "momentum_12_1", "earnings_yield", "book_to_market", "roe",
        "revenue_growth_yoy",
    )


# ------------------------------------------------------------------ queries


def q_clean_prices(m: Market) -> DataFrame:
    return _prices(m)


def _log(m: Market, prices: DataFrame) -> DataFrame:
    return m.stamped(clean.load_log(m.raw_quotes, prices, False, datetime(2002, 1, 1)))


def q_load_log(m: Market) -> DataFrame:
    return _log(m, _prices(m))


def q_duplicate_prices(m: Market) -> DataFrame:
    parsed = clean.parsed_quotes(m.raw_quotes)
    steps = (("typed", parsed.where(clean.usable())), ("clean", clean.unique_quotes(parsed)))
    counts = [
        surplus_rows(df, ["date", "ticker"]).select(F.lit(step).alias("step"), "dupes")
        for step, df in steps
    ]
    return counts[0].unionByName(counts[1])


def q_universe(m: Market) -> DataFrame:
    return m.universe


def q_universe_tickers(m: Market) -> DataFrame:
    return landing.ordered_tickers(m.universe)


def q_wide_to_long(m: Market) -> DataFrame:
    # One column per nation: the nation table has a fixed size.
    names = [r["n"] for r in m.table("nation").select(F.translate("n_name", "_", "-").alias("n")).collect()]
    return landing.quotes_from_wide(m.wide_quotes(names), names)


def q_trading_calendar(m: Market) -> DataFrame:
    return m.trading_calendar


def q_first_filings(m: Market) -> DataFrame:
    return fundamentals.first_filings(m.filing_headers, m.universe)


def q_filing_metrics(m: Market) -> DataFrame:
    return fundamentals.filing_metrics(m.filing_facts, q_first_filings(m))


def q_quarterize(m: Market) -> DataFrame:
    return rounded(
        fundamentals.quarterize(q_filing_metrics(m)), 4,
        "equity", "diluted_shares", "revenue_q", "net_income_q", "eps_q",
    )


def q_fundamentals_ttm(m: Market) -> DataFrame:
    df = rounded(_fundamentals(m), 4, "ttm_revenue", "ttm_eps")
    return rounded(df, 6, "revenue_growth_yoy", "book_value_per_share", "roe")


def q_technicals(m: Market) -> DataFrame:
    return rounded(signals.technicals(_prices(m)), 6, "ma_200", "momentum_12_1")


def q_asof_fundamentals(m: Market) -> DataFrame:
    return _round_joined(_joined(m))


def q_asof_merge(m: Market) -> DataFrame:
    return _round_joined(_joined(m, "merge"))


def _ranks(m: Market, strategy: str) -> DataFrame:
    ranked = signals.sector_ranks(_joined(m), strategy=strategy)
    return rounded(
        ranked.select("date", "ticker", "sector", *signals.FACTOR_RANKS), 6, *signals.FACTOR_RANKS
    )


def q_sector_ranks(m: Market) -> DataFrame:
    return _ranks(m, "window")


def q_sector_ranks_sliced(m: Market) -> DataFrame:
    return _ranks(m, "sliced")


def q_daily_signals(m: Market) -> DataFrame:
    return _round_signals(_signals(m))


def q_daily_signals_sliced(m: Market) -> DataFrame:
    return _round_signals(_signals(m, strategy="sliced"))


def q_todays_signals(m: Market) -> DataFrame:
    # The report reads its table three times, so what it reads of the signals is stored first.
    scored, members = _reported_signals(m)
    latest = members.agg(F.max("date").alias("d")).first()["d"]
    if latest is not None:
        scored = analysis.report_rows(scored, latest, [latest]).drop("whole")
    report = analysis.todays_signals(stage(scored, "signals"), m.universe, latest=latest)
    return rounded(report, 6, "ma_200", "earnings_yield", "roe", "momentum_12_1")


def _validation(m: Market, strategy: str = "window") -> DataFrame:
    scored, members = _reported_signals(m)
    return analysis.signal_validation(scored, days=analysis.month_ends(members), strategy=strategy)


def q_signal_validation(m: Market) -> DataFrame:
    return rounded(_validation(m), 6, "avg_next_month_return", "median_next_month_return")


def q_signal_validation_sliced(m: Market) -> DataFrame:
    return rounded(_validation(m, "sliced"), 6, "avg_next_month_return", "median_next_month_return")


def q_quintile_spread(m: Market) -> DataFrame:
    return rounded(
        analysis.quintile_spread(_validation(m)), 6, "top_return", "bottom_return", "spread"
    )


def q_sector_heatmap(m: Market) -> DataFrame:
    scored, members = _reported_signals(m)
    return rounded(
        analysis.sector_heatmap(scored, analysis.month_ends(members)), 6,
        "buy_share", "sell_share", "net_buy_share", "avg_composite_score",
    )


def q_positions(m: Market) -> DataFrame:
    days = analysis.month_ends(backtest.benchmark_prices(clean.clean_prices(m.benchmark_quotes)))
    return rounded(backtest.positions(_signals(m), days), 6, "next_month_return")


def _curve(m: Market) -> DataFrame:
    # The benchmark's own feed is all the backtest reads of the prices.
    return backtest.backtest(_signals(m), clean.clean_prices(m.benchmark_quotes))


def q_backtest(m: Market) -> DataFrame:
    df = rounded(_curve(m), 6, "strategy_return", "spy_return")
    return rounded(df, 2, "strategy_value", "spy_value")


def q_performance_summary(m: Market) -> DataFrame:
    df = rounded(backtest.performance_summary(_curve(m)), 2, "final_value")
    return rounded(df, 6, "multiple", "annual_return")


def q_price_jumps(m: Market) -> DataFrame:
    return health.price_jumps(_prices(m))


def q_load_health(m: Market) -> DataFrame:
    prices = _stored_prices(m)
    report = health.pipeline_health(m.trading_calendar, _log(m, prices), prices, m.health_as_of)
    return rounded(report, 6, "trailing_avg_rows")


def q_range_replace(m: Market) -> DataFrame:
    """Load all days, then a month again with other rows and without one of its days."""
    path = fresh_path(m.spark, "prices")
    prices, (first, last) = _stored_prices(m), m.days
    writers.replace_range(prices, path, first, last)
    month = first.replace(day=1).replace(year=first.year + 3)
    until = month.replace(day=28)
    again = prices.where(F.col("date").between(F.lit(month), F.lit(until)))
    again = again.where((F.dayofmonth("date") != 11) & (F.col("volume") > 10))
    writers.replace_range(again.withColumn("volume", -F.col("volume")), path, month, until)
    return readers.read_daily(m.spark, path).select("date", "ticker", "close", "volume")


def q_replace_table(m: Market) -> DataFrame:
    """Store prices, then replace them by a table derived from themselves."""
    path = fresh_path(m.spark, "prices")
    writers.replace_table(_prices(m), path)
    stored = readers.read_table(m.spark, path, schemas.PRICES)
    writers.replace_table(stored.where("volume > 10").withColumn("volume", -F.col("volume")), path)
    return readers.read_table(m.spark, path, schemas.PRICES)


def q_catalog_switch(m: Market) -> DataFrame:
    """Replace a catalog table by one derived from it: a reader from before, and one from after."""
    path = fresh_path(m.spark, "switched")
    table = f"signalloom_clean.{path.rsplit('/', 1)[1].replace('-', '_')}"
    catalog.switch_table(_prices(m).where("volume > 10"), table, path)
    catalog.switch_table(_prices(m), table, path)
    before = catalog.read(m.spark, table, schemas.PRICES)
    catalog.switch_table(before.where("volume > 10").withColumn("volume", -F.col("volume")), table, path)
    after = catalog.read(m.spark, table, schemas.PRICES)
    return before.withColumn("seen", F.lit("before")).unionByName(after.withColumn("seen", F.lit("after")))


def q_technicals_step(m: Market) -> DataFrame:
    """Technicals of all days by carried state: two long ranges, then single days at the end."""
    w = Warehouse(m.spark, fresh_path(m.spark, "carried"))
    first, last = m.days
    writers.replace_range(_stored_prices(m), w.path("clean/prices"), first, last)
    ends = [first + (last - first) // 2, *(last - timedelta(days=k) for k in (2, 1, 0))]
    parts, start = [], first
    for end in ends:
        parts.append(stage(w.carry_technicals(start, end), "technicals"))
        start = end + timedelta(days=1)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return rounded(whole, 6, "ma_200", "momentum_12_1")


def _clustered(m: Market) -> tuple[DataFrame, DataFrame]:
    """Prices and fundamentals as catalog tables in buckets of tickers."""
    buckets, tables = int(m.spark.conf.get("spark.sql.shuffle.partitions")), []
    for name, df, sort in (("prices", _prices(m), "date"), ("fundamentals", _fundamentals(m), "available_from")):
        path = fresh_path(m.spark, f"{name}_by_ticker")
        table = path.rsplit("/", 1)[1].replace("-", "_")
        writers.store_clustered(df, table, ["ticker"], [sort], buckets, path)
        tables.append(m.spark.table(table))
    return tables[0], tables[1]


def q_technicals_clustered(m: Market) -> DataFrame:
    return rounded(signals.technicals(_clustered(m)[0]), 6, "ma_200", "momentum_12_1")


def q_asof_clustered(m: Market) -> DataFrame:
    prices, facts = _clustered(m)
    return _round_joined(signals.with_fundamentals(signals.technicals(prices), facts, m.universe, "merge"))


def q_repeated_loads(m: Market) -> DataFrame:
    """The audit log of a first load, of a second one of part of the rows, and of its second try."""
    w = Warehouse(m.spark, fresh_path(m.spark, "loads"))
    prices, raw = _stored_prices(m), m.raw_quotes
    w.log_load(_log(m, prices), "first")
    part = clean.load_log(raw.where("volume > 10"), prices.where("volume > 10"), True, datetime(2002, 1, 1))
    part = part.withColumn("loaded_at", F.expr("cast(partition_date as timestamp_ntz) + INTERVAL 72 HOURS"))
    for _ in range(2):
        w.log_load(part, "second")
    log = w.load_log()
    loads = log.groupBy(F.col("partition_date").alias("date")).agg(F.count("*").alias("loads"))
    return health.latest_loads(log).join(loads, "date")


def q_feed_health(m: Market) -> DataFrame:
    """Health of the benchmark's feed, which has sound days; each third day was loaded again with its rows twice."""
    w = Warehouse(m.spark, fresh_path(m.spark, "feed"))
    raw = m.benchmark_quotes
    prices = stage(clean.clean_prices(raw), "feed")
    w.log_load(m.stamped(clean.load_log(raw, prices, False, datetime(2002, 1, 1))), "first")
    again = raw.where(F.dayofmonth("date") % 3 == 0)
    again = clean.load_log(again.unionByName(again), prices, True, datetime(2002, 1, 1))
    w.log_load(again.withColumn("loaded_at", F.expr("cast(partition_date as timestamp_ntz) + INTERVAL 72 HOURS")), "again")
    report = health.pipeline_health(m.trading_calendar, w.load_log(), prices, m.health_as_of)
    return rounded(report, 6, "trailing_avg_rows")


def q_write_gates(m: Market) -> DataFrame:
    """What the constraints of the price table say to sound prices, to missing closes and to repeated keys."""
    prices = _stored_prices(m)
    tries = {
        "sound": prices,
        "missing": prices.withColumn("close", F.when(F.col("volume") != 10, F.col("close"))),
        "repeated": prices.unionByName(prices.where("volume > 10")),
    }
    path = fresh_path(m.spark, "gated")
    verdicts = []
    for name, df in tries.items():
        try:
            writers.replace_table(writers.constrained(df, schemas.PRICES, ("date", "ticker")), path)
            verdicts.append((name, True))
        except SparkException:  # what was stored before stays
            verdicts.append((name, False))
    stored = readers.read_table(m.spark, path, schemas.PRICES)
    counts = stored.agg(F.count("*").alias("stored_rows"), F.sum("volume").alias("stored_volume"))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("gate"), F.lit(p).alias("passed")) for n, p in verdicts))), "*")


def q_land_filings(m: Market) -> DataFrame:
    """Store facts as tab-delimited text per quarter, land them as Parquet and read all back."""
    spark, base = m.spark, fresh_path(m.spark, "filings")
    filed = m.filing_headers.select(
        "adsh",
        F.concat(
            F.substring("filed", 1, 4), F.lit("q"), F.quarter(F.to_date("filed", "yyyyMMdd"))
        ).alias("quarter"),
    )
    (
        m.filing_facts
        .join(filed, "adsh")
        .write.partitionBy("quarter")
        .options(sep="\t", header=True, quote='"', escape='"', emptyValue="")
        .csv(f"{base}/text")
    )
    text = readers.read_tab_text(spark, f"{base}/text")
    writers.write_quarters(readers.with_text_column(text, "segments"), f"{base}/facts")
    stored = readers.read_quarters(spark, f"{base}/facts")
    return stored.withColumn("value", F.col("value").cast("double"))


def q_landed_years(m: Market) -> DataFrame:
    """Headers and facts of each year landed from text with a broken line; 1998 has no ``segments``.

    What is stored, a row per kind and year: rows, facts without a segment, and rejected lines.
    """
    spark, base = m.spark, fresh_path(m.spark, "landed")
    headers = m.filing_headers.withColumn("year", F.substring("filed", 1, 4))
    facts = m.filing_facts.join(headers.select("adsh", "year"), "adsh")
    years = sorted(r["year"] for r in headers.select("year").distinct().collect())  # a row per year
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "emptyValue": ""}
    for kind, df in (("sub", headers), ("num", facts)):
        df.write.partitionBy("year").options(**options).csv(f"{base}/{kind}")
    facts.where("year = '1998'").drop("year", "segments").write.mode("overwrite").options(**options).csv(f"{base}/num/year=1998")
    names = [c for c in facts.columns if c != "year"]
    for year in years:
        kept = [c for c in names if c != "segments" or year != "1998"]
        broken = spark.createDataFrame([("\t".join(kept) + "\nbroken\t" + year,)], "line string").coalesce(1)
        broken.write.mode("append").text(f"{base}/num/year={year}")
        landing.land_filings(spark, f"{base}/sub/year={year}", f"{base}/num/year={year}", f"{year}q4", f"{base}/raw")
    stored = [
        readers.read_quarters(spark, f"{base}/raw/{kind}", schema).groupBy("quarter").agg(
            F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.count_if(F.col(last).isNull()).alias("gaps"), F.max(F.lit(None).cast("string")).alias("line")
        )
        for kind, schema, last in (("filings", schemas.FILING_HEADERS, "fp"), ("facts", schemas.FILING_FACTS, "segments"))
    ]
    bad = landing.rejected_text(spark, f"{base}/raw").groupBy("quarter", F.concat(F.lit("rejected "), "kind").alias("kind"))
    bad = bad.agg(F.count("*").alias("rows"), F.lit(0).cast("bigint").alias("gaps"), F.max("line").alias("line"))
    return stored[0].unionByName(stored[1]).unionByName(bad)


def q_csv_extracts(m: Market) -> DataFrame:
    """Write the heatmap as an extract and read the file back."""
    folder = fresh_path(m.spark, "extracts")
    report = q_sector_heatmap(m)
    writers.write_extracts({"sector_heatmap": report}, folder)
    return m.spark.read.schema(report.schema).option("header", True).csv(f"{folder}/sector_heatmap")


def q_positions_step(m: Market) -> DataFrame:
    """Positions carried in steps of ever fewer months, one of them tried twice and one after its signals were loaded again."""
    days = analysis.month_ends(backtest.benchmark_prices(clean.clean_prices(m.benchmark_quotes)))
    w = Warehouse(m.spark, fresh_path(m.spark, "positions"))
    w.replace_signals(analysis.on_days(_signals(m), days), *m.days)  # a step reads no other days
    cuts = sorted({days[len(days) // 2], days[-3], days[-2], days[-1]})
    for cut in (*cuts[:2], cuts[1], *cuts[2:]):
        w.carry_positions(cut, days)
    again = w.signals().where(F.col("date") >= F.lit(cuts[1]))
    w.replace_signals(stage(again, "signals"), cuts[1], m.days[1])
    w.carry_positions(cuts[-1], days)
    return rounded(w.positions(), 6, "next_month_return")


def q_all_extracts(m: Market) -> DataFrame:
    """All five extracts of a warehouse, read back: a row per figure with its extract and key."""
    w = Warehouse(m.spark, fresh_path(m.spark, "extracts"))
    writers.replace_table(_prices(m), w.path("clean/prices"))
    # Ranked by window, each day's rows already sit in one partition.
    scored = signals.daily_signals(w.prices(), _fundamentals(m), m.universe)
    w.replace_signals(scored, *m.days, placed=True)
    writers.replace_table(m.universe, w.path("ref/universe"))
    writers.replace_table(m.trading_calendar, w.path("ref/calendar"))
    w.log_load(_log(m, w.prices()), "all")
    w.export_extracts(m.health_as_of)
    keys = {
        "todays_signals": ("ticker", "signal", "signal_since", ("trading_days_in_signal", "composite_score")),
        "signal_validation": ("rebalance_date", "quintile", "quintile", ("stocks", "avg_next_month_return")),
        "backtest": ("rebalance_date", "rebalance_date", "rebalance_date", ("holdings", "strategy_return")),
        "sector_heatmap": ("month", "sector", "sector", ("stocks", "net_buy_share")),
        "pipeline_health": ("date", "status", "status", ("rows_dropped", "suspicious_moves")),
    }
    whole = None
    for name, (key, second, third, figures) in keys.items():
        text = m.spark.read.option("header", True).csv(w.path(f"exports/{name}"))
        part = text.select(
            F.lit(name).alias("extract"), F.col(key).alias("key"), F.col(second).alias("second"), F.col(third).alias("third"),
            *(F.round(F.col(c).cast("double"), 6).alias(f"figure_{i}") for i, c in enumerate(figures, 1)),
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole


_SUPPLIER: dict[str, tuple[Callable[[Market], DataFrame], str]] = {
    "clean_prices": (q_clean_prices, sql.chain("supplier", "prices")),
    "load_log": (q_load_log, sql.chain("supplier", "log")),
    "duplicate_prices": (q_duplicate_prices, sql.duplicate_prices("supplier")),
    "universe": (q_universe, sql.chain("supplier", "universe")),
    "universe_tickers": (q_universe_tickers, sql.chain("supplier", "universe", "ticker")),
    "trading_calendar": (q_trading_calendar, sql.chain("supplier", "calendar")),
    "first_filings": (q_first_filings, sql.first_filings("supplier")),
    "filing_metrics": (q_filing_metrics, sql.chain("supplier", "metrics")),
    "quarterize": (q_quarterize, sql.chain("supplier", "quarters", sql.QUARTER_COLUMNS)),
    "fundamentals_ttm": (
        q_fundamentals_ttm,
        sql.chain("supplier", "fundamentals", sql.FUNDAMENTAL_COLUMNS),
    ),
    "technicals": (q_technicals, sql.chain("supplier", "technicals", sql.TECHNICAL_COLUMNS)),
    "asof_fundamentals": (q_asof_fundamentals, sql.chain("supplier", "joined", sql.JOINED_COLUMNS)),
    "asof_merge": (q_asof_merge, sql.chain("supplier", "joined", sql.JOINED_COLUMNS)),
    "sector_ranks": (q_sector_ranks, sql.chain("supplier", "ranked", sql.RANK_COLUMNS)),
    "sector_ranks_sliced": (
        q_sector_ranks_sliced,
        sql.chain("supplier", "ranked", sql.RANK_COLUMNS),
    ),
    "daily_signals": (q_daily_signals, sql.chain("supplier", "signals", sql.SIGNAL_COLUMNS)),
    "daily_signals_sliced": (
        q_daily_signals_sliced,
        sql.chain("supplier", "signals", sql.SIGNAL_COLUMNS),
    ),
    "todays_signals": (q_todays_signals, sql.todays_signals("supplier")),
    "signal_validation": (
        q_signal_validation,
        sql.chain("supplier", "validation", sql.VALIDATION_COLUMNS),
    ),
    "signal_validation_sliced": (
        q_signal_validation_sliced,
        sql.chain("supplier", "validation", sql.VALIDATION_COLUMNS),
    ),
    "quintile_spread": (q_quintile_spread, sql.quintile_spread("supplier")),
    "sector_heatmap": (q_sector_heatmap, sql.sector_heatmap("supplier")),
    "positions": (q_positions, sql.chain("supplier", "positions", sql.POSITION_COLUMNS)),
    "positions_step": (q_positions_step, sql.chain("supplier", "positions", sql.POSITION_COLUMNS)),
    "all_extracts": (q_all_extracts, sql.all_extracts("supplier")),
    "backtest": (q_backtest, sql.chain("supplier", "curve", sql.CURVE_COLUMNS)),
    "performance_summary": (q_performance_summary, sql.performance_summary("supplier")),
    "price_jumps": (q_price_jumps, sql.chain("supplier", "jumps")),
    "load_health": (q_load_health, sql.chain("supplier", "health", sql.HEALTH_COLUMNS)),
    "range_replace": (q_range_replace, sql.range_replaced("supplier")),
    "technicals_step": (q_technicals_step, sql.chain("supplier", "technicals", sql.TECHNICAL_COLUMNS)),
    "technicals_clustered": (
        q_technicals_clustered,
        sql.chain("supplier", "technicals", sql.TECHNICAL_COLUMNS),
    ),
    "asof_clustered": (q_asof_clustered, sql.chain("supplier", "joined", sql.JOINED_COLUMNS)),
    "repeated_loads": (q_repeated_loads, sql.repeated_loads("supplier")),
    "feed_health": (q_feed_health, sql.feed_health("supplier")),
    "write_gates": (q_write_gates, sql.write_gates("supplier")),
    "replace_table": (q_replace_table, sql.table_replaced("supplier")),
    "catalog_switch": (q_catalog_switch, sql.table_switched("supplier")),
    "land_filings": (q_land_filings, sql.landed_facts("supplier")),
    "landed_years": (q_landed_years, sql.landed_years("supplier")),
    "csv_extracts": (q_csv_extracts, sql.sector_heatmap("supplier")),
}

_NATION: dict[str, tuple[Callable[[Market], DataFrame], str]] = {
    "dedupe_quotes": (q_clean_prices, sql.chain("nation", "prices")),
    "wide_to_long": (q_wide_to_long, sql.wide_to_long("nation")),
    "fundamentals_ttm_dense": (
        q_fundamentals_ttm,
        sql.chain("nation", "fundamentals", sql.FUNDAMENTAL_COLUMNS),
    ),
    "daily_signals_dense": (q_daily_signals, sql.chain("nation", "signals", sql.SIGNAL_COLUMNS)),
    "todays_signals_dense": (q_todays_signals, sql.todays_signals("nation")),
    "signal_validation_dense": (
        q_signal_validation,
        sql.chain("nation", "validation", sql.VALIDATION_COLUMNS),
    ),
    "positions_dense": (q_positions, sql.chain("nation", "positions", sql.POSITION_COLUMNS)),
    "backtest_dense": (q_backtest, sql.chain("nation", "curve", sql.CURVE_COLUMNS)),
    "performance_summary_dense": (q_performance_summary, sql.performance_summary("nation")),
    "load_health_dense": (
        q_load_health,
        sql.chain("nation", "health", sql.HEALTH_COLUMNS),
    ),
}


def _bind(query: Callable[[Market], DataFrame], grain: str) -> Query:
    return lambda spark, sf_dir: query(Market(spark, sf_dir, grain))


def entry(spark: SparkSession) -> DataFrame:
    """Daily signals on the smallest tables."""
    return q_daily_signals(Market(spark, "/root/testdata/sf0.001"))


def _module(name: str):
    """A module of the training-data operators, or None where they are not installed."""
    parent = name.rpartition(".")[0]
    there = (not parent or find_spec(parent)) and find_spec(name)
    return importlib.import_module(name) if there else None


def _shipped(spark: SparkSession) -> None:
    """Give Python workers the package, once per application: they may run in another folder."""
    root = Path(__file__).resolve().parent
    archive = f"{spark.sparkContext.applicationId}-signalloom.zip"
    if not any(str(p).endswith(archive) for p in spark.sparkContext._python_includes):
        path = os.path.join(tempfile.mkdtemp(), archive)  # read by Spark's file server on this machine
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted((root / "signalloom").rglob("*.py")):
                z.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(path)


def _with_code(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _shipped(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    bound = {name: _bind(q, "supplier") for name, (q, _) in _SUPPLIER.items()}
    bound.update({name: _bind(q, "nation") for name, (q, _) in _NATION.items()})
    if llm := _module("signalloom.llm.registry"):
        bound.update({name: _with_code(q) for name, q in llm.QUERIES.items()})
        if corpus := _module("corpus_pipeline"):
            bound["pipeline"] = _with_code(corpus.run)
    return bound


def oracle_sql() -> dict[str, str]:
    texts = {name: text for name, (_, text) in {**_SUPPLIER, **_NATION}.items()}
    if llm := _module("signalloom.llm.registry"):
        texts.update(llm.ORACLES)
        if (corpus := _module("corpus_pipeline")) and corpus.ORACLE_SQL:
            texts["pipeline"] = corpus.ORACLE_SQL
    return texts
