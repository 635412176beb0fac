"""Carried window state, clustered tables, repeated loads and constraints."""

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from signalloom import schemas
from signalloom.plans import analysis, backtest, carried, signals
from signalloom.plans.pipeline import Warehouse
from signalloom.session import fresh_path
from signalloom.sources import readers, writers

D0 = date(2020, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


def panel(spark, days=420, gaps=0.1):
    """Tickers with gaps, one that stops, one that begins late, one of a single day."""
    rng = random.Random(9)
    rows = []
    for t, first, last in (("A", 0, days), ("B", 0, days), ("OLD", 0, 150), ("NEW", 330, days), ("ONE", 400, 401)):
        rows += [(day(n), t, round(rng.uniform(1, 500), 4), n) for n in range(first, last) if rng.random() > gaps or last - first == 1]
    return spark.createDataFrame(rows, schemas.PRICES).repartition(4)


def rows_of(df):
    return sorted(map(tuple, df.select("date", "ticker", "close", "ma_200", "momentum_12_1").collect()), key=str)


def test_steps_equal_windows_to_the_last_bit(spark):
    prices = panel(spark)
    state, got = carried.no_state(spark), []
    for low, high in ((0, 250), (250, 251), (251, 400), (400, 401), (401, 402), (402, 420)):
        part = prices.where(F.col("date").between(F.lit(day(low)), F.lit(day(high - 1))))
        rows, state = carried.step(state, part)
        got += rows_of(rows)
        state = spark.createDataFrame(state.collect(), schemas.TECHNICAL_STATE)
    assert sorted(got, key=str) == rows_of(signals.technicals(prices))
    kept = {r["ticker"]: r for r in state.collect()}
    assert len(kept["A"]["closes"]) == 252 and kept["OLD"]["n"] == len(kept["OLD"]["closes"]) and kept["ONE"]["n"] == 1
    rows, after = carried.step(state, prices.limit(0))
    assert rows.count() == 0 and sorted(after.collect()) == sorted(state.collect())


def test_other_windows(spark):
    prices = panel(spark, 60)
    first, state = carried.step(carried.no_state(spark), prices.where(F.col("date") < F.lit(day(30))), 7, 2, 5)
    second, _ = carried.step(state, prices.where(F.col("date") >= F.lit(day(30))), 7, 2, 5)
    assert sorted(rows_of(first) + rows_of(second), key=str) == rows_of(signals.technicals(prices, 7, 2, 5))


def test_a_day_reads_its_prices_and_the_state_only(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    writers.replace_range(panel(spark), w.path("clean/prices"), day(0), day(419))
    w.carry_technicals(day(0), day(410)).count()
    df = w.carry_technicals(day(411), day(411))
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\]", plan)
    assert any("date" in f and ">" in f and "<=" in f for f in filters)
    assert len(re.findall(r"FileScan parquet", plan)) == 2
    want = signals.technicals(w.prices()).where(F.col("date") == F.lit(day(411)))
    assert rows_of(df) == rows_of(want)
    # Run again it starts from the same state; an earlier day that is loaded again drops later states.
    assert rows_of(w.carry_technicals(day(411), day(411))) == rows_of(want)
    assert w._states() == [day(410), day(411)]
    w._forget_states(day(411))
    assert w._states() == [day(410)]


def test_carried_signals_equal_loaded_ones(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    members = spark.createDataFrame([("A", "a", "S", "1"), ("B", "b", "S", "2"), ("NEW", "n", "S", "3")], "symbol string, security string, sector string, cik string")
    w.store_universe(members)
    writers.replace_range(panel(spark), w.path("clean/prices"), day(0), day(419))
    w.load_signals(day(400), day(419))
    want = sorted(map(str, w.signals().collect()))
    for n in range(400, 420, 4):
        w.load_signals(day(n), day(n + 3), carry=True)
    assert sorted(map(str, w.signals().collect())) == want


def test_history_start_looks_no_further_than_it_must(spark):
    prices = panel(spark, 900, 0.0)
    days = [day(n) for n in range(900)]
    # All of the range's tickers have a year of rows right before it, whatever stopped earlier.
    assert signals.history_start(prices, day(890), end=day(899), days=days) == day(638)
    assert signals.history_start(prices, day(890), end=day(899)) == day(638)
    # ONE traded on day 400 alone, where two others have longer histories.
    assert signals.history_start(prices, day(400), end=day(400), days=days[:401]) == day(148)
    assert signals.history_start(prices, day(0), end=day(5), days=days) is None


def test_clustered_tables_move_nothing(spark):
    prices = panel(spark)
    facts = spark.createDataFrame([("A", day(100), day(120), 1.0, 0.1, 2.0, 3.0, 0.2)], schemas.FUNDAMENTALS)
    tables = []
    for name, df, sort in (("p", prices, "date"), ("f", facts, "available_from")):
        path = fresh_path(spark, f"{name}_by_ticker")
        table = path.rsplit("/", 1)[1].replace("-", "_")
        writers.store_clustered(df, table, ["ticker"], [sort], 4, path)
        tables.append(spark.table(table))
    universe = spark.createDataFrame([("A", "a", "S", 1)], schemas.UNIVERSE)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    technical = signals.technicals(tables[0])
    assert "Exchange" not in text(technical) and "Bucketed: true" in text(technical)
    assert rows_of(technical) == rows_of(signals.technicals(prices))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = signals.with_fundamentals(technical, tables[1], universe)
        # Only the member list, which is not clustered, is moved by ticker.
        assert text(joined).count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_a_repeated_load_logs_once(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    raw = spark.createDataFrame([(str(day(n)), "A", "1.25", 1.0, day(n)) for n in range(3)], schemas.RAW_QUOTES)
    w.land_quotes(raw)
    for at in (1, 2):
        w.load_prices(day(0), day(2), loaded_at=datetime(2024, 1, at), load_id="night")
    assert w.load_log().count() == 3 and {r["loaded_at"] for r in w.load_log().collect()} == {datetime(2024, 1, 2)}
    w.load_prices(day(0), day(2), loaded_at=datetime(2024, 1, 3))
    assert w.load_log().count() == 6


def test_constraints_fail_the_write_and_keep_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(day(0), "A", 1.0, None), (day(0), "B", 1.0, 2)], schemas.PRICES)
    writers.replace_table(writers.constrained(good, schemas.PRICES, ("date", "ticker")), path)
    nullable = good.selectExpr("date", "if(ticker = 'B', null, ticker) AS ticker", "close", "volume")
    for bad, message in ((nullable, "NULL in required column ticker"), (good.unionByName(good.where("ticker = 'B'")), "second row of key .date, ticker.: 2020-01-01, B")):
        with pytest.raises(PySparkException, match=message):
            writers.replace_table(writers.constrained(bad, schemas.PRICES, ("date", "ticker")), path)
    assert readers.read_table(spark, path, schemas.PRICES).count() == 2
    writers.replace_table(writers.constrained(good.limit(0), schemas.PRICES, ("date", "ticker")), path)
    assert readers.read_table(spark, path, schemas.PRICES).count() == 0


def book(spark, months=14):
    """Month-end signals of tickers that come, stop, skip months, and change their calls."""
    rng = random.Random(4)
    rows = []
    for t, first, last in (("A", 0, months), ("B", 0, months), ("OLD", 0, 5), ("NEW", 9, months), ("GAP", 0, months), ("ONE", 6, 7)):
        for n in range(first, last):
            if t == "GAP" and n % 3 == 1:
                continue
            quintile = rng.choice([None, 1, 3, 4, 5])
            signal = "BUY" if quintile == 5 and rng.random() < 0.7 else "HOLD"
            rows.append((month_end(n), t, quintile, signal, round(rng.uniform(1, 9), 3)))
    return spark.createDataFrame(rows, "date date, ticker string, quintile byte, signal string, close double")


def month_end(n):
    return date(2020 + (n + 1) // 12, (n + 1) % 12 + 1, 1) - timedelta(days=1)


def test_positions_in_two_parts_equal_the_whole_for_each_cut(spark):
    signals_, days = book(spark), [month_end(n) for n in range(14)]
    whole = sorted(map(tuple, backtest.positions(signals_, days).collect()), key=str)
    assert any(r[3] for r in whole) and not all(r[3] for r in whole)
    for cut in range(15):
        first, state = backtest.positions_step(backtest.no_positions(spark), signals_, days[:cut])
        state = spark.createDataFrame(state.collect(), schemas.POSITION_STATE)
        second, last = backtest.positions_step(state, signals_, days[cut:])
        parts = first.unionByName(second).unionByName(backtest.open_positions(last))
        assert sorted(map(tuple, parts.collect()), key=str) == whole


def test_carried_positions_follow_reloaded_signals(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    days = [month_end(n) for n in range(14)]
    table = book(spark)
    for f in schemas.SIGNALS:
        if f.name not in table.columns:
            table = table.withColumn(f.name, F.lit(None).cast(f.dataType))
    table = table.select(*schemas.SIGNALS.names)

    def carried_now():
        return sorted(map(tuple, w.positions().collect()), key=str)

    def whole(until):
        kept = [d for d in days if d <= until]
        return sorted(map(tuple, backtest.positions(w.signals(), kept).collect()), key=str)

    assert carried_now() == []
    w.replace_signals(table, days[0], days[-1])
    for cut in (days[4], days[4], days[9], days[8], days[12]):  # one twice, one out of order
        w.carry_positions(cut, days)
    assert carried_now() == whole(days[12])
    changed = table.where(F.col("date") >= F.lit(days[9])).withColumn("close", F.col("close") + 1)
    w.replace_signals(changed, days[9], days[-1])
    assert carried_now() == whole(days[4])  # steps that knew the old signals are gone
    w.carry_positions(days[13], days)
    assert carried_now() == whole(days[13])


def test_a_month_counts_once_it_has_ended(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    quotes = spark.createDataFrame([(D0 + timedelta(days=n), t, 1.0 + n, 1) for n in range(75) for t in ("SPY", "A")], schemas.PRICES)
    writers.replace_table(quotes, w.path("clean/prices"))
    table = quotes.withColumn("quintile", F.lit(5).cast("byte")).withColumn("signal", F.lit("BUY"))
    for f in schemas.SIGNALS:
        if f.name not in table.columns:
            table = table.withColumn(f.name, F.lit(None).cast(f.dataType))
    w.replace_signals(table.select(*schemas.SIGNALS.names), day(0), day(74))
    w.carry_positions(date(2020, 2, 15))
    assert {r["date"] for r in w.positions().collect()} == {date(2020, 1, 31)}
    w.carry_positions(date(2020, 2, 29))
    assert {r["date"] for r in w.positions().collect()} == {date(2020, 1, 31), date(2020, 2, 29)}


def test_reports_over_a_cut_equal_those_over_all_signals(spark, tmp_path):
    table = book(spark, 40).withColumn("composite_score", F.col("close")).withColumn("sector", F.lit("S"))
    latest, ends = month_end(39), [month_end(n) for n in range(0, 40, 4)]
    cut = analysis.report_rows(table, latest, {latest, *ends})
    assert {r["whole"] for r in cut.collect()} == {True, False}
    assert cut.where(~F.col("whole") & F.col("close").isNotNull()).count() == 0
    whole = cut.where("whole").drop("whole")
    for report in (lambda s: analysis.signal_validation(s, 400, ends), lambda s: analysis.sector_heatmap(s, ends), lambda s: backtest.positions(s, ends)):
        assert sorted(map(tuple, report(whole).collect()), key=str) == sorted(map(tuple, report(table).collect()), key=str)
