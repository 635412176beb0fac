import random
from datetime import date, timedelta

import pytest

from signalloom.operators.asof import asof_left

D0 = date(2020, 1, 1)
LEFT = "k string, at date, n int"
RIGHT = "k string, since date, period int, v int"


def day(n):
    return D0 + timedelta(days=n)


def joined(spark, left, right, strategy):
    df = asof_left(
        spark.createDataFrame(left, LEFT),
        spark.createDataFrame(right, RIGHT),
        ["k"], "at", "since", ["period"], strategy,
    )
    assert df.columns == ["k", "at", "n", "since", "period", "v"]
    return {r["n"]: r["v"] for r in df.collect()}


@pytest.mark.parametrize("strategy", ["interval", "merge"])
def test_cases(spark, strategy):
    left = [("a", day(0), 0), ("a", day(5), 1), ("a", day(6), 2), ("a", day(99), 3), ("b", day(9), 4)]
    right = [("a", day(5), 1, 10), ("a", day(7), 2, 20), ("a", day(7), 3, 30), ("c", day(0), 1, 40), ("a", None, 9, 50)]
    got = joined(spark, left, right, strategy)
    # Before the first, on its day, after it, equal starts (the later period wins), no match.
    assert got == {0: None, 1: 10, 2: 10, 3: 30, 4: None}


@pytest.mark.parametrize("strategy", ["interval", "merge"])
def test_brute_force(spark, strategy):
    rng = random.Random(7)
    left = [(rng.choice("abcd"), day(rng.randrange(60)), i) for i in range(400)]
    right = [(rng.choice("abc"), day(rng.randrange(60)), p, rng.randrange(999)) for p in range(60)]
    expected = {}
    for k, at, n in left:
        known = [(s, p, v) for rk, s, p, v in right if rk == k and s <= at]
        expected[n] = max(known)[2] if known else None
    assert joined(spark, left, right, strategy) == expected


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        joined(spark, [("a", D0, 0)], [("a", D0, 1, 1)], "guess")
