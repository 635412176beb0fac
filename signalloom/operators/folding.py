"""Choose a row per key with buffers of fixed width, so that map tasks fold by hash.

``min`` of a struct picks whole rows, but a struct has no fixed width, and Spark sorts all raw rows
by key to fold them. Packed into one number, order and payload are folded in a hash table; rows are
sorted only where that table outgrows its memory.

A positive double is packed as the whole number its bits make, which keeps the order. The number is
computed, since there is no function for it: the exponent from the logarithm, put right by comparing,
and the rest by exact divisions by powers of two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEAST, _MOST = -1022, 1023  # exponents of normal doubles
_ONE = 1 << 52
_WORD = "cast(18446744073709551616 as decimal(20,0))"  # 2 ** 64
_NO_LONG = -(1 << 63)


def _powers() -> Column:
    return F.lit([2.0**e for e in range(_LEAST, _MOST + 1)])


def order_of_double(x: Column) -> Column:
    """The bits of a positive double as a whole number; larger doubles, infinity and NaN have larger ones."""
    # Branches may be computed before it is known which is taken, so none may fail.
    plain = F.when((x >= 2.0**_LEAST) & (x < float("inf")), x).otherwise(1.0)
    near = F.greatest(F.least(F.floor(F.log2(plain)), F.lit(_MOST)), F.lit(_LEAST)).cast("int")
    below = F.get(_powers(), near - _LEAST)
    exponent = F.when(below > plain, near - 1).when(plain / below >= 2, near + 1).otherwise(near)
    rest = plain / F.get(_powers(), exponent - _LEAST) - 1
    normal = (exponent - _LEAST + 1).cast("bigint") * F.lit(_ONE) + (rest * float(_ONE)).cast("bigint")
    tiny = (F.when((x > 0) & (x < 2.0**_LEAST), x).otherwise(0.0) / 2.0**-1074).cast("bigint")
    return (
        F.when(F.isnan(x), F.lit((2047 << 52) + 1))
        .when(x == float("inf"), F.lit(2047 << 52))
        .when(x >= 2.0**_LEAST, normal)
        .when(x > 0, tiny)
    )


def double_of_order(order: Column) -> Column:
    """The double of a number made by :func:`order_of_double`."""
    exponent = F.call_function("div", order, F.lit(_ONE)).cast("int")
    rest = (order % F.lit(_ONE)).cast("double")
    normal = F.get(_powers(), exponent - 1) * (rest / float(_ONE) + 1)
    return (
        F.when(exponent >= 2047, F.when(order > F.lit(2047 << 52), float("nan")).otherwise(float("inf")))
        .when(exponent == 0, rest * 2.0**-1074)
        .otherwise(normal)
    )


def packed(order: Column, payload: Column) -> Column:
    """A DECIMAL(38, 0) that sorts by ``order``, from 0 below 2 ** 63, then by ``payload``, NULL first.

    NULL where ``order`` is. Both are BIGINT. The least BIGINT as a payload stands for NULL.
    """
    # Centred, so that the product stays within 38 digits.
    high = (order - F.lit(1 << 62)).cast("decimal(19,0)") * F.expr(_WORD)
    return (high + F.coalesce(payload, F.lit(_NO_LONG)).cast("decimal(19,0)")).cast("decimal(38,0)")


def unpacked(number: Column) -> tuple[Column, Column]:
    """Order and payload of a packed number."""
    low = F.pmod(number, F.expr(_WORD))
    low = F.when(low >= F.expr("cast(9223372036854775808 as decimal(20,0))"), low - F.expr(_WORD)).otherwise(low)
    low = low.cast("decimal(20,0)")
    high = F.call_function("div", (number - low).cast("decimal(38,0)"), F.expr(_WORD)) + F.lit(1 << 62)
    payload = low.cast("bigint")
    return high, F.when(payload != F.lit(_NO_LONG), payload)
