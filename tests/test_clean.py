from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from signalloom import schemas
from signalloom.operators.dedupe import DuplicateKeys, assert_unique, surplus_rows
from signalloom.plans.clean import clean_prices, load_log, parsed_quotes

DAY = date(2024, 3, 1)


def quotes(spark, *rows):
    return spark.createDataFrame(
        [(t, k, c, v, DAY) for t, k, c, v in rows], schemas.RAW_QUOTES
    )


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-03-01", DAY),
        ("03/01/2024", DAY),
        ("3/1/2024", DAY),
        ("2024-3-1", DAY),
        ("2024-13-45", None),
        ("02/30/2024", None),
        ("2024-03", None),
        ("2024", None),
        ("2024-03-01T00:00:00", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, text, expected):
    assert parsed_quotes(quotes(spark, (text, "A", "1", 1.0))).first()["date"] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("$1,234.50", 1234.5),
        ("12.3456", 12.3456),
        (" 7.5 ", 7.5),
        ("1e3", 1000.0),
        ("-3", -3.0),
        ("0", 0.0),
        ("", None),
        ("n/a", None),
        ("12d", None),
        ("12F", None),
        (None, None),
    ],
)
def test_closes(spark, text, expected):
    assert parsed_quotes(quotes(spark, ("2024-03-01", "A", text, 1.0))).first()["close"] == expected


@pytest.mark.parametrize(
    "value, expected", [(2.5, 2), (2.7, 3), (3.5, 4), (float("nan"), None), (None, None)]
)
def test_volumes_round_half_to_even(spark, value, expected):
    got = parsed_quotes(quotes(spark, ("2024-03-01", "A", "1", value))).first()["volume"]
    assert got == expected


def test_volume_kinds(spark):
    text = quotes(spark, ("2024-03-01", "A", "1", 1.0)).withColumn("volume", F.lit("1.0"))
    assert parsed_quotes(text).first()["volume"] == 1
    large = text.withColumn("volume", F.lit(2**60 + 1).cast("bigint"))
    assert parsed_quotes(large).first()["volume"] == 2**60 + 1


def test_unusable_rows_are_dropped(spark):
    raw = quotes(
        spark,
        ("bad", "A", "1", 1.0),
        ("2024-03-01", "B", "0", 1.0),
        ("2024-03-01", "C", "-1", 1.0),
        ("2024-03-01", "D", "x", 1.0),
        ("2024-03-01", None, "2", 1.0),
        ("2024-03-01", "E", "2", None),
    )
    assert [tuple(r) for r in clean_prices(raw).collect()] == [(DAY, "E", 2.0, None)]


def test_full_precision_wins_then_the_lowest(spark):
    raw = quotes(
        spark,
        ("2024-03-01", "A", "$10.12", 1.0),
        ("03/01/2024", " a ", "10.1234", 2.0),
        ("2024-03-01", "A", "10.1299", 3.0),
        ("2024-03-01", "B", "5.50", 9.0),
        ("2024-03-01", "B", "5.25", 8.0),
        ("2024-03-01", "B", "5.25", 7.0),
    )
    rows = sorted(tuple(r) for r in clean_prices(raw).collect())
    assert rows == [(DAY, "A", 10.1234, 2), (DAY, "B", 5.25, 7)]


def test_uniqueness_gate(spark):
    raw = quotes(spark, ("2024-03-01", "A", "1", 1.0), ("2024-03-01", "A", "2", 1.0))
    assert_unique(clean_prices(raw), ["date", "ticker"])
    doubled = parsed_quotes(raw)
    with pytest.raises(DuplicateKeys) as caught:
        assert_unique(doubled, ["date", "ticker"])
    assert caught.value.rows == 1


def test_surplus_counts_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (1, None)], "a int, b int")
    assert surplus_rows(df, ["a", "b"]).first()["dupes"] == 1
    assert surplus_rows(df.limit(0), ["a", "b"]).first()["dupes"] == 0


def test_load_log_keeps_days_without_clean_rows(spark):
    raw = quotes(spark, ("2024-03-01", "A", "x", 1.0), ("2024-03-01", "B", "y", 1.0))
    at = datetime(2024, 3, 2, 1, 30)
    row = load_log(raw, clean_prices(raw), True, at).first()
    assert tuple(row) == ("clean_prices", DAY, 2, 0, True, at)
