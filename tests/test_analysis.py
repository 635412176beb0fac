import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalloom import schemas
from signalloom.functions import wealth
from signalloom.operators.latch import latch
from signalloom.plans import analysis, backtest


def signal_rows(spark, *rows):
    """Rows of (date, ticker, quintile, signal, close)."""
    names = schemas.SIGNALS.names
    table = []
    for d, t, q, s, c in rows:
        values = dict.fromkeys(names)
        values.update(date=d, ticker=t, sector="S", close=float(c), quintile=q, signal=s)
        values.update(composite_score=None if q is None else q / 5)
        table.append(tuple(values[n] for n in names))
    return spark.createDataFrame(table, schemas.SIGNALS)


MONTHS = [date(2020, m, 28) for m in range(1, 11)]


def test_streaks(spark):
    d = [date(2020, 1, 1) + timedelta(days=i) for i in range(6)]
    calls = {
        "A": ["BUY", "BUY", "HOLD", "BUY", "BUY", "BUY"],
        "B": ["SELL"] * 6,
        "C": ["BUY", "BUY", "BUY", "BUY", "BUY", "SELL"],
        "D": ["BUY"] * 5 + ["HOLD"],
    }
    quintile = {"BUY": 5, "HOLD": 3, "SELL": 1}
    rows = [(d[i], t, quintile[s], s, 1) for t, ss in calls.items() for i, s in enumerate(ss)]
    rows += [(d[0], "OLD", 5, "BUY", 1)]
    df = signal_rows(spark, *rows)
    members = spark.createDataFrame([(t, t + " Inc", "S", 1) for t in "ABCD"], schemas.UNIVERSE)
    got = analysis.todays_signals(df, members).collect()
    assert [(r["ticker"], r["signal"], r["signal_since"], r["trading_days_in_signal"]) for r in got] == [
        ("A", "BUY", d[3], 3),
        ("B", "SELL", d[0], 6),
        ("C", "SELL", d[5], 1),
    ]
    short = analysis.todays_signals(df, members, lookback="2 days").collect()
    assert {r["ticker"]: r["trading_days_in_signal"] for r in short} == {"A": 3, "B": 3, "C": 1}


def test_month_ends_are_the_last_days_with_rows(spark):
    days = [date(2020, 1, 30), date(2020, 1, 31), date(2020, 2, 27), date(2021, 1, 4)]
    df = signal_rows(spark, *[(d, "A", 1, "SELL", 1) for d in days])
    assert analysis.month_ends(df) == [days[1], days[2], days[3]]
    assert analysis.last_of_months(reversed(days)) == [days[1], days[2], days[3]]


@pytest.mark.parametrize("strategy", ["window", "sliced"])
def test_validation_drops_gaps(spark, strategy):
    members = spark.createDataFrame([(t, t, "S", 1) for t in "ABCD"], schemas.UNIVERSE)
    rows = [(MONTHS[0], t, 5, "HOLD", 10) for t in "ABCD"]
    rows += [(MONTHS[1], t, 5, "HOLD", 10 * g) for t, g in zip("ABC", (2, 3, 7))]
    rows += [(MONTHS[2], "D", 5, "HOLD", 99), (MONTHS[2], "A", None, "HOLD", 5)]
    got = analysis.signal_validation(
        signal_rows(spark, *rows), strategy=strategy
    ).collect()
    assert [tuple(r) for r in got] == [
        (MONTHS[0], 5, 3, pytest.approx(3.0), 2.0),
        (MONTHS[1], 5, 1, pytest.approx(-0.75), -0.75),
    ]


def test_spread(spark):
    table = [(MONTHS[0], 1, 0.1), (MONTHS[0], 5, 0.4), (MONTHS[1], 5, 0.2)]
    df = spark.createDataFrame(
        table, "rebalance_date date, quintile tinyint, avg_next_month_return double"
    )
    got = [tuple(r) for r in analysis.quintile_spread(df).collect()]
    assert got == [(MONTHS[0], 0.4, 0.1, pytest.approx(0.3)), (MONTHS[1], 0.2, None, None)]


def test_heatmap(spark):
    df = signal_rows(
        spark,
        (MONTHS[0], "A", 5, "BUY", 1),
        (MONTHS[0], "B", 1, "SELL", 1),
        (MONTHS[0], "C", None, "HOLD", 1),
        (MONTHS[0], "D", 5, "BUY", 1),
        (date(2020, 1, 2), "A", 1, "SELL", 1),
    )
    row = analysis.sector_heatmap(df).collect()
    assert len(row) == 1
    assert tuple(row[0]) == (
        date(2020, 1, 1), "S", 4, 0.5, 0.25, 0.25, pytest.approx((1 + 0.2 + 1) / 3),
    )


def test_latch_equals_a_walk(spark):
    rng = random.Random(4)
    table = []
    for t in range(40):
        for m in range(60):
            q = rng.choice([None, 1, 2, 3, 4, 4, 4, 5, 5, 5])
            table.append((t, m, q, "BUY" if q == 5 and rng.random() < 0.3 else "HOLD"))
    df = spark.createDataFrame(table, "t int, m int, q int, s string")
    series = Window.partitionBy("t").orderBy("m")
    held = latch(F.col("s") == "BUY", F.coalesce("q", F.lit(0)) < 4, series)
    got = {(r["t"], r["m"]): r["held"] for r in df.select("t", "m", held.alias("held")).collect()}
    want, state = {}, {}
    for t, m, q, s in table:
        owned = state.get(t, False)
        state[t] = (q or 0) >= 4 if owned else s == "BUY"
        want[(t, m)] = state[t]
    assert got == want and any(want.values())


def test_hold_band(spark):
    path = [(5, "BUY"), (4, "HOLD"), (3, "HOLD"), (5, "HOLD"), (5, "BUY"), (None, "HOLD"), (5, "BUY")]
    df = signal_rows(spark, *[(MONTHS[i], "A", q, s, 2**i) for i, (q, s) in enumerate(path)])
    rows = backtest.positions(df, MONTHS).orderBy("date").collect()
    assert [r["held"] for r in rows] == [True, True, False, False, True, False, True]
    assert [r["month_no"] for r in rows] == [1, 2, 3, 4, 5, 6, 7]
    assert [r["next_month_return"] for r in rows] == [1.0] * 6 + [None]


def benchmark(spark, closes):
    return spark.createDataFrame(
        [(d, "SPY", float(c), 1) for d, c in zip(MONTHS, closes)], schemas.PRICES
    )


def test_curve(spark):
    rows = []
    for i, (a, b) in enumerate([(1, 1), (2, 1), (2, 3), (1, 3)]):
        rows += [(MONTHS[i], "A", 5, "BUY", a), (MONTHS[i], "B", 5 if i else 1, "BUY" if i else "SELL", b)]
    curve = backtest.backtest(signal_rows(spark, *rows), benchmark(spark, [1, 2, 3, 3]), capital=100)
    got = [tuple(r) for r in curve.collect()]
    assert got == [
        (MONTHS[0], 1, 1.0, 1.0, pytest.approx(200), pytest.approx(200)),
        (MONTHS[1], 2, 1.0, 0.5, pytest.approx(400), pytest.approx(300)),
        (MONTHS[2], 2, -0.25, 0.0, pytest.approx(300), pytest.approx(300)),
    ]
    both = {r["portfolio"]: r for r in backtest.performance_summary(curve, 100).collect()}
    assert both["strategy"]["months"] == 3
    assert both["strategy"]["multiple"] == pytest.approx(3.0)
    assert both["strategy"]["annual_return"] == pytest.approx(3.0**4 - 1)


def test_empty_months_vanish(spark):
    rows = [(MONTHS[i], "A", q, s, 1) for i, (q, s) in enumerate([(1, "SELL"), (5, "BUY"), (1, "SELL"), (1, "SELL")])]
    curve = backtest.backtest(signal_rows(spark, *rows), benchmark(spark, [1, 2, 4, 8]), capital=1)
    assert [(r["rebalance_date"], r["spy_value"]) for r in curve.collect()] == [(MONTHS[1], pytest.approx(2))]


def test_no_holdings_at_all(spark):
    df = signal_rows(spark, (MONTHS[0], "A", 1, "SELL", 1))
    curve = backtest.backtest(df, benchmark(spark, [1, 2]))
    assert curve.count() == 0
    assert backtest.performance_summary(curve).first()["final_value"] is None


def test_total_loss_stays_at_zero(spark):
    df = spark.createDataFrame([(1, 0.5), (2, -1.0), (3, 2.0)], "n int, r double")
    so_far = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = [r[0] for r in df.select(wealth(10, F.col("r"), so_far)).collect()]
    assert got == [pytest.approx(15.0), 0.0, 0.0] and not math.isnan(got[2])
