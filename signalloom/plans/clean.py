"""Typed, unique daily prices and the audit of what was dropped."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions import (
    has_cents_only,
    parse_quote_date,
    parse_quote_price,
    to_whole_number,
)
from signalloom.operators.folding import double_of_order, order_of_double, packed, unpacked


def parsed_quotes(raw: DataFrame) -> DataFrame:
    """Raw quotes with their text parsed; what cannot be read is NULL."""
    return raw.select(
        parse_quote_date(F.col("trade_date")).alias("date"),
        F.upper(F.trim("ticker")).alias("ticker"),
        parse_quote_price(F.col("close")).alias("close"),
        to_whole_number(F.col("volume"), raw.schema["volume"].dataType.simpleString()).alias(
            "volume"
        ),
    )


def usable() -> Column:
    """Whether a parsed quote has a date, a ticker and a positive close."""
    return F.col("date").isNotNull() & F.col("ticker").isNotNull() & (F.col("close") > 0)


def unique_quotes(parsed: DataFrame) -> DataFrame:
    """One usable row per date and ticker: full-precision closes before rounded ones, then the
    lowest, then the lowest volume.

    Folded as two numbers per key, the least quote of either kind, see
    :mod:`signalloom.operators.folding`: no raw row is sorted.
    """
    cents = has_cents_only(F.col("close"))
    quote = packed(F.when(usable(), order_of_double(F.col("close"))), F.col("volume"))
    folded = parsed.groupBy("date", "ticker").agg(F.min(F.when(~cents, quote)).alias("_full"), F.min(F.when(cents, quote)).alias("_cents"))
    best = folded.select("date", "ticker", F.coalesce("_full", "_cents").alias("_best")).where(F.col("_best").isNotNull())
    order, volume = unpacked(F.col("_best"))
    return best.select("date", "ticker", double_of_order(order).alias("close"), volume.alias("volume"))


def clean_prices(raw: DataFrame) -> DataFrame:
    """``date, ticker, close, volume`` with one row per date and ticker."""
    return unique_quotes(parsed_quotes(raw))


def load_log(
    raw: DataFrame, clean: DataFrame, is_backfill: bool, loaded_at: datetime
) -> DataFrame:
    """One audit row per raw day: rows in, rows kept, kind of load and time of load."""
    rows_in = raw.groupBy("date").agg(F.count(F.lit(1)).alias("raw_rows"))
    kept = clean.groupBy("date").agg(F.count(F.lit(1)).alias("clean_rows"))
    return rows_in.join(kept, "date", "left").select(
        F.lit("clean_prices").alias("asset"),
        F.col("date").alias("partition_date"),
        "raw_rows",
        F.coalesce("clean_rows", F.lit(0)).cast("bigint").alias("clean_rows"),
        F.lit(is_backfill).alias("is_backfill"),
        F.lit(loaded_at).cast("timestamp_ntz").alias("loaded_at"),
    )


def rejected_quotes(prices: DataFrame, start: date, end: date) -> DataFrame:
    """Clean quotes dated outside a range they were loaded with."""
    inside = F.col("date").between(F.lit(start), F.lit(end))
    return prices.where(~F.coalesce(inside, F.lit(False)))
