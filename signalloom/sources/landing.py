"""Bring landed files into the layouts the plans read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.schemas import REJECTED_TEXT
from signalloom.sources.readers import read_tab_rows, read_table, with_text_column
from signalloom.sources.writers import replace_partition, write_quarter


def quotes_from_wide(
    wide: DataFrame, tickers: Sequence[str], close: str = "close_", volume: str = "volume_"
) -> DataFrame:
    """One row per date and ticker from a table with a close and a volume column per ticker.

    Tickers without a close on a date get no row.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(t).alias("ticker"),
                F.col(f"`{close}{t}`").alias("close"),
                F.col(f"`{volume}{t}`").alias("volume"),
            )
            for t in tickers
        ]
    )
    return (
        wide.select("date", F.inline(pairs))
        .na.drop(subset=["close"])
    )


def normalise_universe(constituents: DataFrame) -> DataFrame:
    """``ticker, company, sector, cik`` from a landed member list.

    Share classes are written with a dash, as quote feeds do.
    """
    return constituents.select(
        F.translate("symbol", ".", "-").alias("ticker"),
        F.col("security").alias("company"),
        "sector",
        F.col("cik").cast("int").alias("cik"),
    )


def ordered_tickers(universe: DataFrame) -> DataFrame:
    """The members' tickers in order, for the request to the quote feed."""
    return universe.select("ticker").orderBy("ticker")


def trading_sessions(span: DataFrame, holidays: DataFrame) -> DataFrame:
    """One row per expected session: weekdays of ``span`` that are not in ``holidays``.

    ``span`` is one row with ``start`` and ``end`` dates; ``holidays`` has one date column
    ``holiday``. Both sides are bounded by the calendar.
    """
    days = span.select(
        F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("session_date")
    )
    weekdays = days.where(F.weekday("session_date") < 5)
    return weekdays.join(
        holidays, F.col("session_date") == F.col("holiday"), "left_anti"
    )


def land_filings(
    spark: SparkSession, headers_text: str, facts_text: str, quarter: str, base: str, multiline: bool = False
) -> None:
    """Store one quarter's header and fact files as Parquet under ``filings`` and ``facts``.

    Lines that are no rows of their file go to ``rejected_text``, see :func:`rejected_text`. Landing a
    quarter again replaces all of it.
    """
    headers, bad_headers = read_tab_rows(spark, headers_text, multiline)
    facts, bad_facts = read_tab_rows(spark, facts_text, multiline)
    write_quarter(headers, f"{base}/filings", quarter)
    write_quarter(with_text_column(facts, "segments"), f"{base}/facts", quarter)
    for kind, bad in (("filings", bad_headers), ("facts", bad_facts)):
        replace_partition(bad, f"{base}/rejected_text", {"kind": kind, "quarter": quarter})


def rejected_text(spark: SparkSession, base: str) -> DataFrame:
    """``kind``, ``quarter`` and ``line`` of the text that could not be read."""
    return read_table(spark, f"{base}/rejected_text", REJECTED_TEXT)
