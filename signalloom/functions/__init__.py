"""Column expressions. All are built from Spark built-ins, so they stay inside generated code."""

from signalloom.functions.columns import (
    calendar_month,
    has_cents_only,
    mean_present,
    parse_quote_date,
    parse_quote_price,
    parse_yyyymmdd,
    ratio,
    share_where,
    to_whole_number,
    wealth,
)

__all__ = [
    "calendar_month",
    "has_cents_only",
    "mean_present",
    "parse_quote_date",
    "parse_quote_price",
    "parse_yyyymmdd",
    "ratio",
    "share_where",
    "to_whole_number",
    "wealth",
]
