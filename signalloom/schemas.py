"""Table layouts."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*, required: tuple[str, ...] = (), **columns: T.DataType) -> T.StructType:
    """A layout. ``required`` columns are NOT NULL, which is checked when a table is written."""
    return T.StructType([T.StructField(name, kind, name not in required) for name, kind in columns.items()])


def stepped(table: T.StructType) -> T.StructType:
    """A layout stored in ``through=`` folders, a folder per step, with that day."""
    return T.StructType([*table, T.StructField("through", T.DateType())])


_DATE, _TEXT, _REAL, _LONG, _INT = T.DateType(), T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

RAW_QUOTES = _table(trade_date=_TEXT, ticker=_TEXT, close=_TEXT, volume=_REAL, date=_DATE)

FILING_HEADERS = _table(
    adsh=_TEXT, cik=_TEXT, form=_TEXT, period=_TEXT, filed=_TEXT, accepted=_TEXT, fy=_TEXT, fp=_TEXT
)

FILING_FACTS = _table(
    adsh=_TEXT, tag=_TEXT, ddate=_TEXT, qtrs=_TEXT, value=_TEXT, coreg=_TEXT, segments=_TEXT
)

UNIVERSE = _table(ticker=_TEXT, company=_TEXT, sector=_TEXT, cik=_INT)

TRADING_CALENDAR = _table(session_date=_DATE)

PRICES = _table(required=("date", "ticker", "close"), date=_DATE, ticker=_TEXT, close=_REAL, volume=_LONG)

#: What a ticker's windows reach back to: rows so far, and the last closes, oldest first.
TECHNICAL_STATE = _table(ticker=_TEXT, n=_LONG, closes=T.ArrayType(_REAL))

#: The latest month end of each ticker: its number, and whether the strategy holds the stock after it.
POSITION_STATE = _table(date=_DATE, ticker=_TEXT, month_no=_LONG, held=T.BooleanType(), close=_REAL)

POSITIONS = _table(
    date=_DATE, ticker=_TEXT, month_no=_LONG, held=T.BooleanType(), next_month_return=_REAL
)

FUNDAMENTALS = _table(
    ticker=_TEXT,
    period_end=_DATE,
    available_from=_DATE,
    ttm_revenue=_REAL,
    revenue_growth_yoy=_REAL,
    ttm_eps=_REAL,
    book_value_per_share=_REAL,
    roe=_REAL,
)

SIGNALS = _table(
    date=_DATE,
    ticker=_TEXT,
    sector=_TEXT,
    close=_REAL,
    ma_200=_REAL,
    momentum_12_1=_REAL,
    earnings_yield=_REAL,
    book_to_market=_REAL,
    roe=_REAL,
    revenue_growth_yoy=_REAL,
    value_score=_REAL,
    quality_score=_REAL,
    momentum_score=_REAL,
    composite_score=_REAL,
    quintile=T.ByteType(),
    signal=_TEXT,
)

LOAD_LOG = _table(
    asset=_TEXT,
    partition_date=_DATE,
    raw_rows=_LONG,
    clean_rows=_LONG,
    is_backfill=T.BooleanType(),
    loaded_at=T.TimestampNTZType(),
)

REJECTED_QUOTES = _table(
    date=_DATE, ticker=_TEXT, close=_REAL, volume=_LONG, load_start=_DATE, load_end=_DATE
)

REJECTED_TEXT = _table(kind=_TEXT, quarter=_TEXT, line=_TEXT)
