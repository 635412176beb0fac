from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def parse_quote_date(text: Column) -> Column:
    """Date from ``2024-03-01`` or ``03/01/2024`` text, one-digit parts allowed; NULL if neither.

    A slash tells the two layouts apart, so each row is tried against one pattern only and the
    cost of a failed parse is paid by bad rows alone.
    """
    return F.when(text.contains("/"), F.try_to_date(text, "M/d/yyyy")).otherwise(
        F.try_to_date(text, "yyyy-M-d")
    )


def parse_yyyymmdd(text: Column) -> Column:
    """Date from ``20240301`` text; bad text is an error."""
    return F.to_date(text, "yyyyMMdd")


def parse_quote_price(text: Column) -> Column:
    """Double from text such as ``$1,234.50``; NULL when it is not a number.

    Spark's cast would take a trailing ``d`` or ``f`` as part of a number; quotes do not.
    """
    bare = F.lower(F.trim(F.translate(text, "$,", "")))
    suffixed = bare.endswith("d") | (bare.endswith("f") & ~bare.endswith("inf"))
    return F.when(~suffixed, bare.try_cast("double"))


def has_cents_only(price: Column) -> Column:
    """Whether a price carries no more than two decimals."""
    return F.rint(price * 100) / 100 == price


def to_whole_number(value: Column, type_name: str) -> Column:
    """BIGINT from a numeric or text column, halves to even, NULL when it is not a number."""
    if type_name in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("bigint")
    return F.rint(value.try_cast("double")).try_cast("bigint")


def mean_present(*columns: Column) -> Column:
    """Mean of the non-NULL arguments, NULL when there are none."""
    total = F.coalesce(columns[0], F.lit(0.0))
    present = columns[0].isNotNull().cast("int")
    for c in columns[1:]:
        total = total + F.coalesce(c, F.lit(0.0))
        present = present + c.isNotNull().cast("int")
    return F.when(present > 0, total / present)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, NULL when the bottom is zero."""
    return F.try_divide(top, bottom)


def calendar_month(day: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(day, "MM")


def share_where(condition: Column) -> Column:
    """Aggregate: share of rows for which the condition holds."""
    return F.avg(condition.cast("int"))


def wealth(capital: float, period_return: Column, over: WindowSpec) -> Column:
    """Capital compounded over the returns up to the current row.

    A loss of everything keeps the value at zero from there on, where the sum of logarithms
    alone would lose the row.
    """
    growth = F.exp(F.sum(F.when(period_return > -1, F.ln(1 + period_return))).over(over))
    ruined = F.min(period_return).over(over) <= -1
    return F.when(ruined, F.lit(0.0)).otherwise(F.lit(float(capital)) * growth)
