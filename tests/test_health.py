from datetime import date, datetime, timedelta

from signalloom import schemas
from signalloom.plans.health import latest_loads, pipeline_health, price_jumps

MONDAY = date(2024, 1, 1)
DAYS = [MONDAY + timedelta(days=i) for i in range(10)]


def log_of(spark, *rows):
    """Rows of (day, raw, clean, backfill, hours after midnight)."""
    table = [
        ("clean_prices", d, raw, kept, back, datetime(d.year, d.month, d.day) + timedelta(hours=h))
        for d, raw, kept, back, h in rows
    ]
    return spark.createDataFrame(table, schemas.LOAD_LOG)


def prices_of(spark, *rows):
    return spark.createDataFrame([(d, t, c, 1) for d, t, c in rows], schemas.PRICES)


def calendar(spark, days):
    return spark.createDataFrame([(d,) for d in days], schemas.TRADING_CALENDAR)


def test_statuses_and_precedence(spark):
    log = log_of(
        spark,
        (DAYS[0], 100, 100, False, 25),
        (DAYS[1], 100, 0, False, 40),  # no rows: MISSING although late
        (DAYS[2], 100, 40, False, 31),  # LATE before LOW_VOLUME
        (DAYS[3], 100, 40, True, 31),  # a backfill is never late; low against the mean of 46.7
        (DAYS[4], 100, 90, False, 25),
        (DAYS[6], 100, 100, False, 30),  # exactly thirty hours is in time
        (DAYS[7], 100, 100, False, 25),
    )
    prices = prices_of(
        spark,
        (DAYS[3], "A", 10.0), (DAYS[4], "A", 20.0), (DAYS[6], "A", 9.0), (DAYS[7], "A", 13.5),
    )
    report = pipeline_health(calendar(spark, DAYS), log, prices, as_of=DAYS[8])
    got = {r["date"]: r for r in report.collect()}
    assert [got[d]["status"] for d in DAYS[:8]] == [
        "OK", "MISSING", "LATE", "LOW_VOLUME", "HIGH_DUPES", "MISSING", "CHECK_PRICES", "OK",
    ]
    assert DAYS[8] not in got  # the day of the report is not over
    assert got[DAYS[4]]["suspicious_moves"] == 1 and got[DAYS[5]]["suspicious_moves"] == 0
    assert got[DAYS[2]]["trailing_avg_rows"] == 50.0
    assert got[DAYS[5]]["raw_rows"] is None and got[DAYS[0]]["trailing_avg_rows"] is None


def test_report_starts_with_the_first_log_row(spark):
    log = log_of(spark, (DAYS[4], 1, 1, False, 25))
    report = pipeline_health(calendar(spark, DAYS), log, prices_of(spark), as_of=DAYS[6])
    assert [r["date"] for r in report.collect()] == [DAYS[4], DAYS[5]]


def test_latest_load_wins(spark):
    log = log_of(
        spark,
        (DAYS[0], 10, 8, False, 26),
        (DAYS[0], 12, 9, True, 50),
        (DAYS[0], 11, None, True, 60),
    )
    row = latest_loads(log).first()
    assert (row["raw_rows"], row["clean_rows"]) == (11, 9)
    assert row["first_scheduled_load"] == datetime(2024, 1, 2, 2)


def test_trailing_mean_leaves_out_the_day_itself_and_old_days(spark):
    days = [MONDAY + timedelta(days=i) for i in range(22)]
    log = log_of(spark, *[(d, 1000, 1000 if i == 0 else 10, True, 1) for i, d in enumerate(days)])
    report = pipeline_health(calendar(spark, days), log, prices_of(spark), as_of=days[-1] + timedelta(days=1))
    rows = report.collect()
    assert rows[20]["trailing_avg_rows"] == (1000 + 19 * 10) / 20
    assert rows[21]["trailing_avg_rows"] == 10.0


def test_jumps_need_more_than_half(spark):
    prices = prices_of(
        spark,
        (DAYS[0], "A", 10.0), (DAYS[1], "A", 15.0), (DAYS[2], "A", 7.0), (DAYS[0], "B", 1.0), (DAYS[2], "B", 9.0),
    )
    assert [tuple(r) for r in price_jumps(prices).collect()] == [(DAYS[2], 2)]
