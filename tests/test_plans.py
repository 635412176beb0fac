"""Shapes of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from signalloom import schemas
from testing.market import Market
from signalloom.plans import analysis, clean, fundamentals, signals
from signalloom.sources import readers, writers

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (hash|range|single|Round)", plan(df)))


@pytest.fixture
def without_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Price, fundamental and universe tables on disk."""
    base = str(tmp_path_factory.mktemp("tables"))
    m = Market(spark, FOLDER)
    clean.clean_prices(m.raw_quotes).write.parquet(f"{base}/prices")
    facts = fundamentals.company_fundamentals(m.filing_headers, m.filing_facts, m.universe)
    facts.write.parquet(f"{base}/facts")
    m.universe.write.parquet(f"{base}/universe")
    return [spark.read.parquet(f"{base}/{n}") for n in ("prices", "facts", "universe")]


def test_dedupe_folds_before_its_only_shuffle(spark):
    df = clean.clean_prices(Market(spark, FOLDER).stock_quotes)
    assert shuffles(df) == 1
    below = plan(df).split("Exchange")[1]
    assert "partial_min" in below


def test_signals_shuffle_once_by_ticker_and_once_by_day(spark, stored):
    text = plan(signals.daily_signals(*stored))
    assert text.count("Exchange hashpartitioning(date") == 1
    assert text.count("Exchange hashpartitioning") <= 3
    assert text.count("percent_rank(") >= 5


def test_large_sides_merge_without_moving_the_prices_again(spark, stored, without_broadcast):
    text = plan(signals.daily_signals(*stored))
    assert text.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in text
    # Prices by ticker once, the universe and the filings by ticker, then all by day.
    assert text.count("Exchange hashpartitioning(ticker") == 3
    assert text.count("Exchange hashpartitioning(date") == 1


def test_facts_are_folded_before_they_meet_the_filings(spark, stored, without_broadcast):
    m = Market(spark, FOLDER)
    filings = fundamentals.first_filings(m.filing_headers, m.universe)
    text = plan(fundamentals.filing_metrics(m.filing_facts, filings))
    join = text.index("SortMergeJoin")
    assert text.index("partial_max") > join


def test_month_ends_prune_folders_and_pass_below_the_rankings(spark, stored, tmp_path):
    prices, facts, universe = stored
    table = signals.daily_signals(prices, facts, universe)
    days = analysis.month_ends(prices)
    text = plan(analysis.sector_heatmap(table, days))
    # Once filtered by the list of days, nothing above the last window filters again.
    assert text.rindex("INSET") > text.rindex("ntile")
    path = str(tmp_path / "signals")
    some = table.where(F.col("date") < "1995-03-01")
    writers.replace_range(some, path, days[0].replace(month=1, day=1), days[1])
    stored_signals = readers.read_table(spark, path, schemas.SIGNALS)
    scan = plan(analysis.sector_heatmap(stored_signals, days[:1]))
    assert re.search(r"PartitionFilters: \[.*date", scan)


def test_scans_read_what_they_need(spark, stored):
    prices = stored[0]
    text = plan(signals.technicals(prices.where(F.col("date") >= "1996-01-01")))
    assert re.search(r"ReadSchema: struct<date:date,ticker:string,close:double>", text)
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in text


def test_tag_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "facts")
    Market(spark, FOLDER).filing_facts.write.parquet(path)
    text = plan(fundamentals.reported_values(spark.read.parquet(path)))
    assert "PushedFilters: [" in text and "In(tag" in text and "IsNull(coreg)" in text
