"""Packed orders, and the dedupe that folds by hash."""

import random
import struct
from datetime import date

from pyspark.sql import functions as F

from signalloom import schemas
from signalloom.operators.dedupe import first_per_key
from signalloom.operators.folding import double_of_order, order_of_double, packed, unpacked
from signalloom.functions import has_cents_only
from signalloom.plans.clean import clean_prices, parsed_quotes, unique_quotes, usable
from testing.market import Market


def test_order_is_the_bits_of_a_double(spark):
    rng = random.Random(2)
    values = [5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1.0, 0.1, 12.3456, float("inf")]
    for e in range(-1022, 1024, 7):
        values += [2.0**e, 2.0**e * (1 + 2**-52), 2.0**e * (2 - 2**-52), 2.0**e * rng.uniform(1, 2)]
    values += [rng.uniform(0.01, 5000) for _ in range(2000)] + [round(rng.uniform(0.01, 5000), 2) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", order_of_double(F.col("x")).alias("o"))
    for r in df.select("x", "o", double_of_order(F.col("o")).alias("y")).collect():
        assert r["o"] == struct.unpack(">q", struct.pack(">d", r["x"]))[0] and r["y"] == r["x"]
    odd = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (-1.0,)], "x double").select(order_of_double(F.col("x")).alias("o"))
    found = odd.select("o", double_of_order(F.col("o")).alias("y")).collect()
    assert found[0]["o"] > 2047 << 52 and found[0]["y"] != found[0]["y"] and [r["o"] for r in found[1:]] == [None] * 3


def test_packed_numbers_sort_and_come_back(spark):
    longs = [0, 1, -1, 5, (1 << 63) - 1, -(1 << 63) + 1, 1 << 40, None]
    orders = [0, 1, (1 << 62) - 1, 1 << 62, (2047 << 52) + 1, 4607182418800017408]
    rows = [(o, v) for o in orders for v in longs] + [(None, 3)]
    df = spark.createDataFrame(rows, "o bigint, v bigint").select("*", packed(F.col("o"), F.col("v")).alias("k"))
    back = unpacked(F.col("k"))
    got = df.select("o", "v", "k", back[0].alias("o2"), back[1].alias("v2")).collect()
    assert all((r["o"], r["v"]) == (r["o2"], r["v2"]) for r in got if r["o"] is not None)
    assert [r["k"] for r in got if r["o"] is None] == [None]
    known = [r for r in got if r["o"] is not None]
    key = lambda r: (r["o"], r["v"] is not None, r["v"] or 0)
    assert sorted(known, key=lambda r: r["k"]) == sorted(known, key=key)


def test_dedupe_equals_the_least_struct_and_sorts_no_raw_row(spark):
    day = date(2024, 3, 1)
    rng = random.Random(4)
    closes = ["1.5", "1.50", "2", "1.2345", "1.2346", "n/a", "-1", "0", None, "inf", "nan", "1e-310", "$1,000.123"]
    data = [("2024-03-01" if rng.random() < 0.9 else "03/02/2024", f" t{rng.randrange(60)} ", rng.choice(closes), rng.choice([1.0, 2.0, None, -3.0]), day) for _ in range(2000)]
    parsed = parsed_quotes(spark.createDataFrame(data, schemas.RAW_QUOTES))
    want = first_per_key(parsed, ["date", "ticker"], [has_cents_only(F.col("close")), F.col("close")], keep=usable())
    assert sorted(map(str, unique_quotes(parsed).collect())) == sorted(map(str, want.collect()))
    df = clean_prices(Market(spark, "/root/testdata/sf0.001").stock_quotes)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and plan.count("HashAggregate") == 2
    assert clean_prices(spark.createDataFrame([], schemas.RAW_QUOTES)).count() == 0
